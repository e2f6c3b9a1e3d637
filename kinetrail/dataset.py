"""A trajectory dataset: frames with their episode, task, robot and instruction tables. Every method gives a new one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kinetrail.features import features_of
from kinetrail.operators import filters, lookups, temporal
from kinetrail.schema import DIMENSIONS, INDEX, refuse_reserved

PARTS = ("frames", "episodes", "tasks", "robots", "instructions")


@dataclass(frozen=True)
class TrajectoryDataset:
    frames: DataFrame
    episodes: DataFrame
    tasks: DataFrame | None = None
    robots: DataFrame | None = None
    instructions: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrajectoryDataset:
        """Opens a saved dataset with its features; tables that it lacks are None, tables that do not belong together are refused."""
        from kinetrail.sources.store import exists

        made = cls(**{p: spark.read.option("mergeSchema", "true").parquet(f"{path}/{p}") for p in PARTS if p in PARTS[:2] or exists(spark, f"{path}/{p}")})
        made.check()
        return made

    def check(self) -> None:
        """Refuses tables without their keys, frames that name a dimension which is not there, and features that are not as stored."""
        for p in ("frames", "episodes"):
            if "episode_index" not in getattr(self, p).columns:
                raise ValueError(f"{p} has no episode_index")
        for d in DIMENSIONS:
            table = getattr(self, f"{d}s")
            if table is not None and f"{d}_index" not in table.columns:
                raise ValueError(f"{d}s has no {d}_index")
        for p in PARTS:
            if getattr(self, p) is not None:
                features_of(getattr(self, p))

    def strays(self) -> DataFrame:
        """(part, key, n): keys of frames that no row of the part has; empty if all tables belong together."""
        out = None
        for p in PARTS[1:]:
            key = f"{p.removesuffix('s')}_index"
            if (table := getattr(self, p)) is not None and key in self.frames.columns:
                asked = self.frames.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.count("*").alias("n"))
                lost = asked.join(table.select(F.col(key).cast("long").alias("key")), "key", "left_anti").select(F.lit(p).alias("part"), "key", "n")
                out = lost if out is None else out.unionByName(lost)
        return out

    def at(self, which: int | slice | list[int] | str) -> DataFrame:
        """Frames by place: one (negative from the end), a slice (its step may be negative), a list with repeats; or a column by name.

        ``pos`` is the order asked for. Places beyond the end are an error for single ones and lists, as for Python's lists. Frames are
        numbered by index from 0, so that no row is counted but for the dataset's length.
        """
        if isinstance(which, str):
            return self.frames.select("index", which)
        if isinstance(which, slice):
            start, stop, step = which.indices(self.frames.count())
            away = F.col("index") - start
            inside = (F.col("index") >= start) & (F.col("index") < stop) if step > 0 else (F.col("index") <= start) & (F.col("index") > stop)
            return self.frames.where(inside & (away % abs(step) == 0)).withColumn("pos", F.floor(away / step).cast("long"))
        n = self.frames.count()
        asked = [which] if isinstance(which, int) else which
        if bad := [i for i in asked if not -n <= i < n]:
            raise IndexError(f"place {bad[0]} of {n} frames")
        rows = self.frames.sparkSession.createDataFrame([(k, i + n if i < 0 else i) for k, i in enumerate(asked)], "pos long, index long")
        return rows.join(self.frames, "index")

    def save(self, path: str, max_rows_per_file: int = 0, replace_existing: bool = False, max_shard_bytes: int | None = None) -> None:
        """Writes all tables beside the target, then moves them there as one folder.

        With ``max_shard_bytes`` frames lie in files of consecutive indices of about so many bytes (as ``sharding.row_bytes`` counts, before
        Parquet compresses them) at most, but for one larger row in a file.
        """
        from kinetrail.operators import sharding
        from kinetrail.sources.store import published

        with published(self.frames.sparkSession, path, replace_existing) as at:
            for p in PARTS:
                if (df := getattr(self, p)) is not None:
                    if p == "frames" and max_shard_bytes is not None:
                        cut = sharding.byte_shards(df, max_shard_bytes, ["index"])
                        many = (cut.agg(F.max("shard")).first()[0] or 0) + 1
                        # A shard is a partition, and so a file.
                        df = cut.repartitionById(many, F.col("shard").cast("int")).sortWithinPartitions("index").drop("bytes", "shard")
                    df.write.option("maxRecordsPerFile", max_rows_per_file).parquet(f"{at}/{p}")

    def index(self) -> DataFrame:
        """Index columns only: what planning reads."""
        return self.frames.select(*[c for c in INDEX if c in self.frames.columns])

    def select_columns(self, names: list[str], include_index: bool = True) -> TrajectoryDataset:
        kept = [c for c in self.frames.columns if c in names or (include_index and c in INDEX)]
        return replace(self, frames=self.frames.select(*kept))

    def rename_columns(self, names: dict[str, str]) -> TrajectoryDataset:
        refuse_reserved(*names, *names.values())
        return replace(self, frames=self.frames.withColumnsRenamed(names))

    def select(self, indices: DataFrame) -> TrajectoryDataset:
        """Frames at ``indices`` (pos, index), repeats allowed, with ``pos`` as their order. Episodes stay as they are."""
        return replace(self, frames=indices.join(self.frames, "index"))

    def filter(self, **predicates: Column) -> TrajectoryDataset:
        """By predicates on ``episode``, ``task``, ``robot``, ``instruction`` and ``row``."""
        return replace(self, frames=filters.composite(self.frames, self.episodes, self.tasks, self.robots, self.instructions, **predicates))

    def offset_window(self, offsets: dict[str, list[int | None]]) -> TrajectoryDataset:
        return replace(self, frames=temporal.offset_window(self.frames, offsets))

    def delta_window(self, deltas: dict[str, list[float]], tolerance: float = 0.01) -> TrajectoryDataset:
        return replace(self, frames=temporal.delta_window(self.frames, deltas, tolerance))

    def chunk(self, columns: list[str], hist_steps: int = 1, pred_steps: int = 64, pred_interval: int = 1) -> TrajectoryDataset:
        return replace(self, frames=temporal.chunk(self.frames, columns, hist_steps, pred_steps, pred_interval))

    def with_metadata(self) -> DataFrame:
        """Frames with the rows of their dimensions in place of the keys."""
        dims = {n: d for n, d in (("task", self.tasks), ("robot", self.robots), ("instruction", self.instructions)) if d is not None}
        return lookups.expanded(self.frames, dims)

    def row(self, index: int) -> Row | None:
        return self.frames.where(F.col("index") == index).first()

    def rows(self) -> Iterator[Row]:
        """Frames in order, a partition at a time."""
        return self.frames.orderBy("index").toLocalIterator()

    def counts(self) -> dict[str, int]:
        return {p: df.count() for p in PARTS if (df := getattr(self, p)) is not None}

    def transform(self, f: Any, *args: Any, **kwargs: Any) -> TrajectoryDataset:
        return replace(self, frames=self.frames.transform(f, *args, **kwargs))

    def transformed(self, change: Callable[[TrajectoryDataset], TrajectoryDataset]) -> TrajectoryDataset:
        """By an EpisodeTransform, or any function of datasets."""
        return change(self)

    def ordered(self, part: str) -> DataFrame:
        """A dimension table by its index."""
        return getattr(self, part).orderBy(f"{part.removesuffix('s')}_index")

    def sql(self, statement: str) -> DataFrame:
        """A SELECT over the dataset's tables, named in braces: ``{frames}``, ``{episodes}``, ``{tasks}``, ..."""
        return self.frames.sparkSession.sql(statement, **{p: df for p in PARTS if (df := getattr(self, p)) is not None})
