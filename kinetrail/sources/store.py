"""Datasets on disk: building from raw rows, atomic publication, import of flat robot tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrail.operators.algebra import identity
from kinetrail.tables import positions, stored


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


@contextmanager
def published(spark: SparkSession, path: str, replace_existing: bool = False) -> Iterator[str]:
    """A staging folder beside ``path``; on success it becomes ``path`` by a rename, on failure it goes and the target stays."""
    fs, target = _fs(spark, path)
    if fs.exists(target) and not replace_existing:
        raise FileExistsError(path)
    staged, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        yield staged
    except BaseException:
        fs.delete(_fs(spark, staged)[1], True)
        raise
    moved = fs.exists(target) and fs.rename(target, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, staged)[1], target):
        if moved:
            fs.rename(_fs(spark, old)[1], target)
        raise OSError(f"could not publish {path}")
    if moved:
        fs.delete(_fs(spark, old)[1], True)


def packaged(raw: DataFrame, episode: list[str], order: list[str], dimensions: dict[str, list[str]] | None = None, sizes: DataFrame | None = None) -> dict[str, DataFrame]:
    """frames, episodes and dimension tables from raw rows; ``sizes`` (episode, frame_num), if they are known, may name episodes without rows.

    Episodes are the distinct ``episode`` keys in order, frames their rows in ``order``; a dimension
    is the distinct content of its columns, numbered by first episode and content. Episode
    numbers and begin offsets come from a two-phase count over the episodes; only sorting
    within an episode is per episode.
    """
    sizes = raw.groupBy(*episode).agg(F.count("*").alias("frame_num")) if sizes is None else sizes
    episodes = positions(sizes, episode, "episode_index", "frame_num", "dataset_begin_index")
    inside = Window.partitionBy(*episode).orderBy(*order)
    numbered = raw.withColumn("frame_index", (F.row_number().over(inside) - 1).cast("long"))
    keys = episodes.select(*[F.col(e).alias(f"_e{k}") for k, e in enumerate(episode)], "episode_index", "dataset_begin_index")
    frames = numbered.join(keys, [F.col(e).eqNullSafe(F.col(f"_e{k}")) for k, e in enumerate(episode)])
    frames = frames.select(*episode, *[c for c in numbered.columns if c not in episode], "episode_index", "dataset_begin_index")
    frames = frames.withColumn("index", F.col("dataset_begin_index") + F.col("frame_index")).drop("dataset_begin_index")
    out = {}
    for name, columns in (dimensions or {}).items():
        dim = frames.withColumn("_md5", identity(*[F.col(c) for c in columns]))
        rows = dim.groupBy("_md5", *columns).agg(F.min("episode_index").alias("_first"))
        table = positions(rows, ["_first", "_md5", *columns], f"{name}_index").drop("_first").withColumnRenamed("_md5", "md5")
        keyed = table.select(f"{name}_index", *[F.col(c).alias(f"_{c}") for c in columns])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
        frames = frames.join(keyed, same).drop(*columns, *[f"_{c}" for c in columns])
        out[f"{name}s"] = table
    return {"frames": frames, "episodes": episodes, **out}


class FailedEpisode(ValueError):
    """An episode that cannot be packaged, where the first failure is to end the job."""


def unordered_times(start: str = "timestamp_min", end: str = "timestamp_max") -> Column:
    """Why a frame's times cannot be used; null if they can."""
    lost = F.col(start).isNull() | F.col(end).isNull()
    return F.when(lost, F.lit("a frame must have both times")).when(F.col(start) > F.col(end), F.lit("a frame must not end before it begins"))


def packaged_with_failures(raw: DataFrame, episode: list[str], order: list[str], failure: Column, skip: Column | None = None, fail_fast: bool = False, dimensions: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """``packaged`` with an error channel: frames, episodes, dimensions and a ``quarantine`` table.

    ``failure`` is a frame's reason to fail, null if it is good (``try_*`` functions make one without failing the job); ``skip`` is an
    aggregate over an episode's rows, its metadata's reason. An episode ends before its first failed frame in ``order`` and keeps the frames
    before it, maybe none; one with a reason to skip is left out and has no number. quarantine has (episode columns, kind ``frame`` or
    ``episode``, reason, at (struct of ``order``, null for an episode), kept, lost: its rows). With ``fail_fast`` the first failure
    raises. The first failed frame is a minimum for each episode, so that no task sorts an episode to find it; null episode keys are an episode.
    """
    at = F.struct(*order)
    marked = raw.withColumns({"_reason": failure, "_at": at})
    ends = marked.where("_reason is not null").groupBy(*episode).agg(F.min(F.struct("_at", "_reason")).alias("_end"))
    whole = marked.groupBy(*episode).agg(F.count("*").alias("_rows"), (F.lit(None).cast("string") if skip is None else skip).alias("_skip"))
    keys = {f"_e{k}": F.col(e) for k, e in enumerate(episode)}
    same = [F.col(e).eqNullSafe(F.col(f"_e{k}")) for k, e in enumerate(episode)]
    known = stored(whole.join(ends.withColumns(keys).drop(*episode), same, "left").select(*episode, "_rows", "_skip", "_end"))
    broken = known.where("_skip is not null or _end is not null")
    if fail_fast and (first := broken.orderBy(*episode).first()):
        raise FailedEpisode(f"{', '.join(f'{e} {first[e]}' for e in episode)}: {first['_skip'] or first['_end']['_reason']}")
    good = marked.drop("_reason").join(known.where("_skip is null").withColumns(keys).drop(*episode, "_rows", "_skip"), same)
    good = good.where(F.col("_end").isNull() | (F.col("_at") < F.col("_end._at"))).drop(*keys, "_end", "_at")
    kept = stored(good)
    counts = kept.groupBy(*episode).agg(F.count("*").alias("_kept"))
    met = stored(known.join(counts.withColumns(keys).drop(*episode), same, "left").select(*known.columns, F.coalesce("_kept", F.lit(0)).cast("long").alias("_kept")))
    out = packaged(kept, episode, order, dimensions, met.where("_skip is null").select(*episode, F.col("_kept").alias("frame_num")))
    frame = F.col("_skip").isNull()
    out["quarantine"] = met.where("_skip is not null or _end is not null").select(
        *episode,
        F.when(frame, F.lit("frame")).otherwise(F.lit("episode")).alias("kind"),
        F.coalesce("_skip", "_end._reason").alias("reason"),
        F.when(frame, F.col("_end._at")).alias("at"),
        F.col("_kept").alias("kept"),
        (F.col("_rows") - F.col("_kept")).alias("lost"),
    )
    return out


def saved_together(tables: dict[str, DataFrame], path: str, replace_existing: bool = False) -> dict[str, DataFrame]:
    """Tables published at ``path``/name by one rename: all of them are there, or none."""
    spark = next(iter(tables.values())).sparkSession
    with published(spark, path, replace_existing) as staged:
        for name, table in tables.items():
            table.write.parquet(f"{staged}/{name}")
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in tables}


def flat_robot_table(rows: DataFrame, fps: float, max_frames: int | None = None, episode: str = "episode_index", frame: str = "frame_index") -> DataFrame:
    """A table with one row a frame, with nanosecond times: those of a ``timestamp`` column in seconds, else frame / fps; at most ``max_frames`` an episode."""
    seconds = F.col("timestamp") if "timestamp" in rows.columns else F.col(frame) / float(fps)
    out = rows.withColumn("timestamp_min", F.floor(seconds.cast("double") * 1e9).cast("long")).withColumn("timestamp_max", F.col("timestamp_min"))
    if max_frames is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(episode).orderBy(frame))).where(F.col("_n") <= max_frames).drop("_n")
    return out


def episode_messages(frames: DataFrame, topics: dict[str, str]) -> DataFrame:
    """(episode_index, topic, log_time, data): a message for each frame and column of ``topics`` (column to topic)."""
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.col(c).cast("string").alias("data")) for c, t in topics.items()]))
    timed = frames.where("timestamp_min is not null")
    return timed.select("episode_index", F.col("timestamp_min").alias("log_time"), rows.alias("m")).select("episode_index", "m.topic", "log_time", "m.data")


def job_slice(rows: DataFrame, jobs: int, job: int, pos: str = "pos") -> DataFrame:
    """The contiguous slice of ceil(n / jobs) rows of one of several jobs."""
    n = rows.count()
    size = -(-n // jobs)
    return rows.where((F.col(pos) >= job * size) & (F.col(pos) < (job + 1) * size))


def saved(table: DataFrame, path: str, replace_existing: bool = False) -> DataFrame:
    """``table`` published at ``path`` and read from there."""
    spark = table.sparkSession
    with published(spark, path, replace_existing) as staged:
        table.write.parquet(staged)
    return spark.read.parquet(path)
