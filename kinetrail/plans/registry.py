"""Registered queries: a function over (spark, sf_dir) and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.sources.store import exists, packaged
from kinetrail.tables import read, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` may use the CTE ``frames``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = FRAMES + sql if "frames" in sql else sql
        return f

    return add


#: Frames as SQL: users are episodes, events their frames, event types tasks.
FRAMES = """
WITH frames AS (
  SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS "index",
    dense_rank() OVER (ORDER BY user_id) - 1 AS episode_index,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
    dense_rank() OVER (ORDER BY event_type) - 1 AS task_index,
    epoch_ns(ts) AS timestamp_min, epoch_ns(ts) AS timestamp_max,
    user_id, event_id, event_type, value, props FROM events)
"""


def nanoseconds_of(ts: str = "ts") -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, in any session time zone."""
    whole = F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (whole * 1000000 + (F.date_part(F.lit("SECOND"), F.col(ts)) * 1000000).cast("long")) * 1000


#: Saved datasets by application, source and the state of its files.
_SAVED: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at a path, so that a rewritten table is another one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def dataset(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Events as a trajectory dataset, frames and episodes: packaged and saved once in an application, read with pruned columns by each query."""
    key = (spark.sparkContext.applicationId, sf_dir, _files(spark, f"{sf_dir}/events.parquet"))
    at = _SAVED.get(key)
    if at is None or not exists(spark, f"{at}/episodes"):
        at = f"{shared_dir(spark).rstrip('/')}/kinetrail/dataset-{uuid4().hex}"
        parts = packaged(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
        when = nanoseconds_of()
        parts["frames"].withColumns({"timestamp_min": when, "timestamp_max": when}).write.parquet(f"{at}/frames")
        parts["episodes"].write.parquet(f"{at}/episodes")
        _SAVED[key] = at
    return {p: spark.read.parquet(f"{at}/{p}") for p in ("frames", "episodes")}


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir)["frames"]


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]
