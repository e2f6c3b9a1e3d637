"""From message logs and annotation files to rows: decoding, synchronised frames, stateful conversion, flattened annotations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.functions import geometry, wire
from kinetrail.operators import temporal
from kinetrail.sources.store import packaged
from kinetrail.tables import positions


def decoded(messages: DataFrame, topic: str, ddl: str, strict: bool = True) -> DataFrame:
    """Messages of a topic with struct ``message`` of their JSON; broken ones fail the job, or without ``strict`` give null fields."""
    text = F.decode("data", "UTF-8") if messages.schema["data"].dataType.typeName() == "binary" else F.col("data")
    return messages.where(F.col("topic") == topic).withColumn("message", F.from_json(text, ddl, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))


def decoded_by_encoding(messages: DataFrame, topic: str, layout: wire.Layout, strict: bool = True) -> DataFrame:
    """Messages of a topic with struct ``message``, read as each one's column ``encoding`` says: json, protobuf or cdr; others fail the job, or give null."""
    known = ("json", "protobuf", "cdr")
    rows = messages.where(F.col("topic") == topic)
    if strict:
        refused = F.raise_error(F.concat(F.lit("encoding is not supported: "), F.coalesce("encoding", F.lit("null")))).cast("string")
        rows = rows.withColumn("encoding", F.when(F.col("encoding").isin(*known), F.col("encoding")).otherwise(refused))
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    of = lambda encoding: F.when(F.col("encoding") == encoding, F.col("data"))  # noqa: E731  (null elsewhere, so that only its own bodies are read)
    structs = [F.from_json(F.decode(of("json"), "UTF-8"), layout.ddl(), mode), *[wire.decoded(of(e), layout, e, strict) for e in known[1:]]]
    return rows.withColumn("message", F.coalesce(*structs))


def encoded_as(message: Column, layout: wire.Layout, encoding: str) -> Column:
    """A struct as the binary body of a message, in json, protobuf or cdr."""
    return F.encode(F.to_json(message), "UTF-8") if encoding == "json" else wire.encoded(message, layout, encoding)


@dataclass(frozen=True)
class Stream:
    """A topic, the DDL of its messages, and the frame columns made of their fields (column to field)."""

    topic: str
    ddl: str
    columns: Mapping[str, str]

    def rows(self, messages: DataFrame, kept: list[str]) -> DataFrame:
        return decoded(messages, self.topic, self.ddl).select(*kept, *[F.col(f"message.{f}").alias(c) for c, f in self.columns.items()])


def log_frames(messages: DataFrame, log: str, order: list[str], base: Stream, others: list[Stream], tolerance: int | None = None, moving: str | None = None, threshold: float = 0.0) -> dict[str, DataFrame]:
    """frames and episodes of message logs, one log an episode.

    Each message of ``base`` is a frame; the nearest message in time of every other stream gives its
    columns, null beyond ``tolerance`` ns. With ``moving``, frames where that column differs from
    the message before by ``threshold`` or less go, but for a log's first. ``order`` ends with what tells equal times apart.
    """
    kept = list(dict.fromkeys([log, "log_time", *order]))
    frames = base.rows(messages, kept)
    if moving is not None:
        change = F.col(moving) - F.lag(moving).over(Window.partitionBy(log).orderBy(*order))
        frames = frames.withColumn("_change", change).where(F.col("_change").isNull() | (F.abs("_change") > threshold)).drop("_change")
    for k, stream in enumerate(others):
        values = stream.rows(messages, [log, "log_time"]).select(log, "log_time", F.struct(*stream.columns).alias(f"_s{k}"))
        frames = temporal.nearest(frames, values, f"_s{k}", [log])
        near = F.lit(True) if tolerance is None else F.col("apart") <= tolerance
        frames = frames.withColumns({c: F.when(near, F.col(f"_s{k}.{c}")) for c in stream.columns}).drop(f"_s{k}", "apart")
    return packaged(frames.withColumns({"timestamp_min": F.col("log_time"), "timestamp_max": F.col("log_time")}), [log], order)


def ascending(messages: DataFrame, log: str, order: list[str]) -> DataFrame:
    """``messages``; a log whose times fall in ``order`` fails the job."""
    before = F.lag("log_time").over(Window.partitionBy(log).orderBy(*order))
    refused = F.raise_error(F.lit("log times must not fall")).cast("long")
    return messages.withColumn("log_time", F.when(F.col("log_time") < before, refused).otherwise(F.col("log_time")))


def converted(messages: DataFrame, log: str, order: list[str], start: Callable[[object], dict], step: Callable[[dict, object], list[tuple]], flush: Callable[[dict], list[tuple]], schema: str, quiet: int | None = None) -> DataFrame:
    """Rows of a stateful converter run over each log in order.

    start(log) gives a state, step(state, message) the rows of a message, flush(state) those that
    are left when the log ends, or when its next message comes more than ``quiet`` ns of log_time later: then it begins
    anew. Sorted rows stream through, so only the state is held.
    """
    names = list(messages.sparkSession.createDataFrame([], schema).columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, last = None, None, None
        for frame in frames:
            out: list[tuple] = []
            for message in frame.itertuples(index=False):
                key = getattr(message, log)
                if state is None or key != at or (quiet is not None and message.log_time - last > quiet):
                    out += flush(state) if state is not None else []
                    at, state = key, start(key)
                out += step(state, message)
                last = None if quiet is None else message.log_time
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(flush(state), columns=names)

    return messages.repartition(log).sortWithinPartitions(log, *order).mapInPandas(run, schema)


def annotations(scenes: DataFrame, scene: str, instances: str, views: str) -> DataFrame:
    """(scene, place, <instance fields>, visible): a row for each instance, ``visible`` telling for each view whether it names its id.

    ``instances`` is an array of structs with ``id``, ``views`` an array of arrays of ids; scenes without instances give none.
    Views name ids, not rows: instances of one id in a scene are all visible where a view names it. A null id is visible nowhere.
    """
    each = scenes.select(scene, views, F.posexplode(instances).alias("place", "_instance"))
    return each.withColumn("visible", F.transform(views, lambda ids: F.coalesce(F.array_contains(ids, F.col("_instance.id")), F.lit(False)))).select(scene, "place", "_instance.*", "visible")


def with_files(episodes: DataFrame, wanted: Column, listing: DataFrame, episode: str) -> DataFrame:
    """Episodes of which ``listing`` (_episode, _file) has every file of the array ``wanted``."""
    asked = episodes.select(F.col(episode).alias("_asked"), F.explode(wanted).alias("_name"))
    lost = asked.join(listing, (F.col("_asked") == F.col("_episode")) & (F.col("_name") == F.col("_file")), "left_anti")
    return episodes.join(lost, F.col(episode) == F.col("_asked"), "left_anti")


def episode_ranges(episodes: DataFrame) -> DataFrame:
    """``episodes`` (dataset, episode_index, frame_num) laid end to end: a number over all, and the frames [start, end) of each."""
    laid = positions(episodes, ["dataset", "episode_index"], "episode", "frame_num", "start")
    return laid.withColumn("end", F.col("start") + F.col("frame_num"))


def collated(rows: DataFrame, order: list[str], size: int, columns: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(batch, <columns>): each ``size`` rows in order as one; a column's function gets the array of its values."""
    kept = F.array_sort(F.collect_list(F.struct("_pos", *columns)))
    batches = positions(rows, order, "_pos").groupBy(F.floor(F.col("_pos") / size).alias("batch")).agg(kept.alias("_rows"))
    return batches.select("batch", *[f(F.col(f"_rows.{c}")).alias(c) for c, f in columns.items()])


#: Fields of the public JSON message layouts for frame transforms and camera calibration.
TRANSFORMS = "transforms array<struct<parent_frame_id: string, child_frame_id: string, translation: struct<x: double, y: double, z: double>, rotation: struct<x: double, y: double, z: double, w: double>>>"
CALIBRATION = "frame_id string, width long, height long, D array<double>, K array<double>"


#: Fields of the public JSON message layouts for joint states and stamped poses.
JOINT_STATE = "name array<string>, position array<double>, velocity array<double>, effort array<double>"
POSE = "frame_id string, position struct<x: double, y: double, z: double>, orientation struct<x: double, y: double, z: double, w: double>"


def joints_of(messages: DataFrame, topic: str, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """(keys, names, position, velocity, effort) of a topic's joint states; with ``names`` in their order, null for joints a message lacks."""
    found = decoded(messages, topic, JOINT_STATE)
    m = F.col("message")
    if names is None:
        return found.select(*keys, m["name"].alias("names"), *[m[c].alias(c) for c in ("position", "velocity", "effort")])
    at = lambda c, n: F.get(m[c], (F.array_position(m["name"], F.lit(n)) - 1).cast("int"))
    return found.select(*keys, F.array(*map(F.lit, names)).alias("names"), *[F.array(*[at(c, n) for n in names]).alias(c) for c in ("position", "velocity", "effort")])


def joint_messages(rows: DataFrame, topic: str, keys: list[str]) -> DataFrame:
    """(keys, topic, data): rows (names, position, and velocity and effort where they have such columns) as JSON messages."""
    fields = [F.col("names").alias("name"), *[(F.col(c) if c in rows.columns else F.lit(None).cast("array<double>")).alias(c) for c in ("position", "velocity", "effort")]]
    return rows.select(*keys, F.lit(topic).alias("topic"), F.encode(F.to_json(F.struct(*fields)), "UTF-8").alias("data"))


def poses_of(messages: DataFrame, topic: str, keys: list[str]) -> DataFrame:
    """(keys, frame, matrix): a topic's stamped poses as 4 x 4."""
    m = F.col("message")
    place, turn = [m["position"][a] for a in "xyz"], [m["orientation"][a] for a in "wxyz"]
    return decoded(messages, topic, POSE).select(*keys, m["frame_id"].alias("frame"), geometry.pose_of(place, turn).alias("matrix"))


def pose_messages(rows: DataFrame, topic: str, keys: list[str]) -> DataFrame:
    """(keys, topic, data): rows (frame, translation of three, rotation w x y z) as JSON messages."""
    place = F.struct(*[F.get("translation", F.lit(k)).alias(a) for k, a in enumerate("xyz")])
    turn = F.struct(*[F.get("rotation", F.lit("wxyz".index(a))).alias(a) for a in "xyzw"])
    body = F.struct(F.col("frame").alias("frame_id"), place.alias("position"), turn.alias("orientation"))
    return rows.select(*keys, F.lit(topic).alias("topic"), F.encode(F.to_json(body), "UTF-8").alias("data"))


def transforms_of(messages: DataFrame, topic: str, keys: list[str]) -> DataFrame:
    """(keys, parent, child, matrix): a row for each transform in the messages of a topic, as 4 x 4."""
    each = decoded(messages, topic, TRANSFORMS).select(*keys, F.explode("message.transforms").alias("t"))
    matrix = geometry.pose_of([F.col(f"t.translation.{a}") for a in "xyz"], [F.col(f"t.rotation.{a}") for a in "wxyz"])
    return each.select(*keys, F.col("t.parent_frame_id").alias("parent"), F.col("t.child_frame_id").alias("child"), matrix.alias("matrix"))


def transform_messages(rows: DataFrame, topic: str, keys: list[str]) -> DataFrame:
    """(keys, topic, data): rows (parent, child, translation of three, rotation w x y z) of equal keys as one JSON message."""
    place = F.struct(*[F.get("translation", F.lit(k)).alias(a) for k, a in enumerate("xyz")])
    turn = F.struct(*[F.get("rotation", F.lit("wxyz".index(a))).alias(a) for a in "xyzw"])
    one = F.struct(F.col("parent").alias("parent_frame_id"), F.col("child").alias("child_frame_id"), place.alias("translation"), turn.alias("rotation"))
    made = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("transforms"))
    return made.select(*keys, F.lit(topic).alias("topic"), F.encode(F.to_json(F.struct("transforms")), "UTF-8").alias("data"))


def calibrations_of(messages: DataFrame, topic: str, keys: list[str]) -> DataFrame:
    """(keys, frame, width, height, distortion, intrinsic): a camera's calibration messages, the intrinsic as 4 x 4."""
    m = F.col("message")
    found = decoded(messages, topic, CALIBRATION)
    return found.select(*keys, m["frame_id"].alias("frame"), m["width"].alias("width"), m["height"].alias("height"), m["D"].alias("distortion"), geometry.intrinsic_4x4(m["K"]).alias("intrinsic"))
