"""Rows put together from several tables: cameras of frames, composed datasets, rows parsed for training, grounding texts, boxes seen by views, records of topic maps."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.functions.geometry import intrinsic_4x4, inverse_rigid
from kinetrail.operators.algebra import concatenated
from kinetrail.operators.imports import episode_ranges

#: Words that make a description depend on where one looks from.
VIEW_WORDS = ("front", "behind", "back", "left", "right", "facing", "leftmost", "rightmost", "looking", "across")
UNIT = [float(k % 5 == 0) for k in range(16)]


def _in_unit(matrix: Column, rows: int, columns: int) -> Column:
    """4 x 4 with the upper left ``rows`` x ``columns`` of a matrix of as many columns or of four, the rest as in the unit matrix."""
    wide = F.when(F.size(matrix) % 4 == 0, 4).otherwise(columns)
    return F.when(matrix.isNotNull(), F.array(*[F.get(matrix, (i * wide + j).cast("int")) if i < rows and j < columns else F.lit(UNIT[4 * i + j]) for i, j in ((k // 4, k % 4) for k in range(16))]))


def camera_rows(frames: DataFrame, cameras: DataFrame, moving: DataFrame, recording: str, step: str, names: list[str] | None = None) -> DataFrame:
    """``frames`` with ``cameras``, an array of (camera, intrinsic, world_to_camera) of 4 x 4 in order of name, or those of ``names`` in their order.

    cameras: recording, camera, intrinsic (9 or 16 numbers), world_to_camera (12 or 16, null for a moving one); moving: recording, camera, step,
    world_to_camera. A fixed camera has one matrix for all steps, a moving one that of each frame's step: an equi join on recording, camera and step,
    so that no frame carries a recording's matrices. A camera without a matrix for the step has null there.
    """
    place = F.col("camera") if names is None else F.array_position(F.array(*map(F.lit, names)), F.col("camera"))
    known = cameras if names is None else cameras.where(F.col("camera").isin(names))
    known = known.select(F.col(recording).alias("_r"), "camera", place.alias("_place"), F.col("intrinsic").alias("_k"), F.col("world_to_camera").alias("_fixed"))
    keys = frames.select(recording, step).distinct()
    there = moving.select(F.col(recording).alias("_r2"), F.col("camera").alias("_c2"), F.col(step).alias("_s2"), F.col("world_to_camera").alias("_moved"))
    met = keys.join(known, F.col(recording) == F.col("_r")).join(there, (F.col("_r") == F.col("_r2")) & (F.col("camera") == F.col("_c2")) & (F.col(step) == F.col("_s2")), "left")
    one = F.struct("_place", "camera", _in_unit(F.col("_k"), 3, 3).alias("intrinsic"), _in_unit(F.coalesce("_fixed", "_moved"), 3, 4).alias("world_to_camera"))
    every = met.groupBy(F.col(recording).alias("_r"), F.col(step).alias("_s")).agg(F.array_sort(F.collect_list(one)).alias("cameras"))
    every = every.withColumn("cameras", F.transform("cameras", lambda c: F.struct(c["camera"].alias("camera"), c["intrinsic"].alias("intrinsic"), c["world_to_camera"].alias("world_to_camera"))))
    out = frames.join(every, (F.col(recording) == F.col("_r")) & (F.col(step) == F.col("_s")), "left").drop("_r", "_s")
    return out


def composed(datasets: list, parse: Callable[[DataFrame], DataFrame], windows: Mapping[str, list[int | None]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, episodes) of several datasets as one: windows over each one's frames, then ``parse``, laid end to end.

    frames have dataset_index and ``index``, their place over all; episodes (dataset, episode_index, frame_num, episode, start, end) their numbers and ranges over all.
    """
    shown = [d.offset_window(dict(windows)) if windows else d for d in datasets]
    frames = concatenated([parse(d.frames) for d in shown])
    sizes = [d.frames.groupBy("episode_index").agg(F.count("*").alias("frame_num")).withColumn("dataset", F.lit(k)) for k, d in enumerate(datasets)]
    every = sizes[0]
    for more in sizes[1:]:
        every = every.unionByName(more)
    ranges = episode_ranges(every)
    start = ranges.groupBy(F.col("dataset").alias("_d")).agg(F.min("start").alias("_start"))  # a row a dataset
    frames = frames.join(start, F.col("dataset_index") == F.col("_d")).withColumn("index", F.col("index") + F.col("_start")).drop("_d", "_start")
    return frames, ranges


def parsed_rows(rows: DataFrame, cameras: list[str], hist_steps: int = 1, depth_scale: float = 1000.0) -> DataFrame:
    """``rows`` with what a policy is trained on: joint_state, master_joint_state, intrinsic, world_to_camera, depths, text, step_index, step_index_in_chunk, uuid.

    rows: frame_index, joints and actions (arrays of positions, as ``chunk`` makes them), instruction and info (JSON texts) and for each camera
    a struct (frame_id, intrinsic, pose (parent, child, matrix), height, width) and, where depths were taken, ``<camera>_depth``, an array by row.
    Matrices and depths are arrays in the order of ``cameras``. Depths are divided by ``depth_scale``; a missing or null one is
    zeros of the first camera's size. A pose is from the camera to ``world``: one with another parent, or whose child is
    neither the camera nor its frame, is refused. A null camera or pose has null there, a null or broken JSON text null.
    """
    numbers = lambda name: F.col(name).cast("array<array<double>>")
    zeros = F.array_repeat(F.lit(0.0), F.col(cameras[0])["height"] * F.col(cameras[0])["width"])

    def world_to(name: str) -> Column:
        camera, pose = F.col(name), F.col(name)["pose"]
        right = (pose["parent"] == "world") & pose["child"].isin(F.lit(name), camera["frame_id"])
        refused = F.raise_error(F.concat(F.lit(f"pose of {name} goes from "), F.coalesce(pose["child"], F.lit("null")), F.lit(" to "), F.coalesce(pose["parent"], F.lit("null"))))
        return F.when(pose.isNull(), F.lit(None)).when(right, inverse_rigid(pose["matrix"])).otherwise(refused.cast("array<double>"))

    def depth(name: str) -> Column:
        column = f"{name}_depth"
        return F.coalesce(F.transform(F.col(column).cast("array<double>"), lambda d: d / depth_scale), zeros) if column in rows.columns else zeros

    return rows.withColumns(
        {
            "joint_state": numbers("joints"),
            "master_joint_state": numbers("actions"),
            "intrinsic": F.array(*[F.when(F.col(c).isNotNull(), intrinsic_4x4(F.col(c)["intrinsic"])) for c in cameras]),
            "world_to_camera": F.array(*map(world_to, cameras)),
            "depths": F.array(*map(depth, cameras)),
            "text": F.get_json_object("instruction", "$.description"),
            "step_index": F.col("frame_index"),
            "step_index_in_chunk": F.lit(hist_steps - 1),
            "uuid": F.get_json_object("info", "$.uuid"),
        }
    )


def grounding_flags(texts: DataFrame, distractors: str = "distractor_ids", text: str = "text") -> DataFrame:
    """``texts`` with is_unique (no distractor), is_hard (over three), is_view_dep (a word of VIEW_WORDS); null where the column is null."""
    words = F.split(F.col(text), r"\s+")
    flags = {"is_unique": F.size(distractors) == 0, "is_hard": F.size(distractors) > 3}
    known = {n: F.when(F.col(distractors).isNotNull(), f) for n, f in flags.items()}
    return texts.withColumns({**known, "is_view_dep": F.arrays_overlap(words, F.array(*map(F.lit, VIEW_WORDS)))})


def view_boxes(scenes: DataFrame, scene: str, images: str, instances: str, many: int, low: float, high: float) -> DataFrame:
    """(scene, view, box, world_to_view): boxes visible in ``many`` images of each scene, whose height z lies in (low, high).

    images is an array of structs with ``visible`` (places in instances) and ``world_to_view``, instances an array of boxes (arrays, z third). Images are
    evenly spaced; a scene of fewer shows all of them as often as they go into ``many``, and evenly spaced ones for the rest.
    """
    n = F.size(images)
    rest = F.lit(many) % n
    whole = F.flatten(F.array_repeat(F.sequence(F.lit(0), n - 1), F.floor(F.lit(many) / n).cast("int")))
    some = F.when(rest > 0, F.transform(F.sequence(F.lit(0), rest - 1), lambda i: F.floor(i * n / rest).cast("int"))).otherwise(F.array().cast("array<int>"))
    places = F.concat(whole, some)
    chosen = scenes.where(n > 0).select(scene, instances, images, F.explode(places).alias("view")).withColumn("_image", F.get(images, F.col("view")))
    seen = chosen.select(scene, "view", F.col("_image.world_to_view").alias("world_to_view"), instances, F.explode("_image.visible").alias("_at"))
    boxes = seen.select(scene, "view", F.get(instances, F.col("_at").cast("int")).alias("box"), "world_to_view")
    z = F.get("box", F.lit(2))
    return boxes.where((z > low) & (z < high))


def dict_records(logs: DataFrame, key: list[str], topics: Mapping[str, Mapping[str, Callable[[Column], Column]] | None]) -> DataFrame:
    """(key, idx, source, topic, log_time, data) of columns that are arrays of (log_time, data), in the order of ``topics``.

    A topic's converter makes messages of one or several final topics of its data, all at the message's log time; None passes data on.
    idx counts a log's records in input order. A null array is no message.
    """
    kind = "array<struct<source: string, topic: string, log_time: bigint, data: string>>"

    def records(source: str, makers: Mapping[str, Callable[[Column], Column]]) -> Column:
        one = lambda m, t, f: F.struct(F.lit(source).alias("source"), F.lit(t).alias("topic"), m["log_time"].alias("log_time"), f(m["data"]).cast("string").alias("data"))
        every = F.flatten(F.transform(F.col(source), lambda m: F.array(*[one(m, t, f) for t, f in makers.items()])))
        return F.coalesce(every.cast(kind), F.array().cast(kind))

    parts = [records(source, makers or {source: lambda d: d}) for source, makers in topics.items()]
    return logs.select(*key, F.posexplode(F.concat(*parts)).alias("idx", "r")).select(*key, "idx", "r.*")
