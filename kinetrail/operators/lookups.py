"""Joins of frames with their dimensions, and routing of positions to parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.tables import positions, stored

#: Parts that may begin in one bucket of ``routed``.
CROWD = 64


def expanded(frames: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Each ``<name>_index`` replaced by the dimension's row as struct ``<name>``; null for null and unknown keys.

    Spark broadcasts a dimension by its measured size and else shuffles on the key.
    """
    for name, dim in dimensions.items():
        key = f"{name}_index"
        row = dim.select(F.col(key).alias("_key"), F.struct(*[c for c in dim.columns if c != key]).alias(name))
        frames = frames.join(row, F.col(key) == F.col("_key"), "left").drop("_key", key)
    return frames


def fetched(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` for each of ``keys`` (pos, key), repeats and order kept by pos; null for unknown ones."""
    return keys.join(table.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")


def routed(asked: DataFrame, parts: DataFrame) -> DataFrame:
    """``asked`` (pos) with part and the place in it; parts (part, size) lie end to end, negative positions count from the end.

    Where parts begin are prefix sums by range partition. A position meets its part by an equi join on buckets of the line of positions; a
    bucket is as wide as an average part, and one that more parts than ``CROWD`` begin in is cut again, to single positions, so that one huge
    part among many small ones crowds no bucket.
    """
    laid = positions(parts.where("size > 0").select("part", "size"), ["part"], "_place", "size", "_start").drop("_place")
    n, many = parts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when(F.col("size") > 0, 1))).first()
    width = max(-(-n // max(many, 1)), 1)
    bucket = lambda at: F.floor(at / width)
    crowded = laid.groupBy(bucket(F.col("_start")).alias("_crowd")).count().where(F.col("count") > CROWD).select("_crowd")
    last = F.col("_start") + F.col("size") - 1
    named = laid.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_start")), bucket(last))))
    marked = named.join(crowded, F.col("_bucket") == F.col("_crowd"), "left")
    # In a crowded bucket a part names each of its positions there, the bucket's width in sum; elsewhere the whole bucket, as -1.
    low, high = F.greatest("_start", F.col("_bucket") * width), F.least(last, F.col("_bucket") * width + width - 1)
    named = marked.withColumn("_at", F.explode(F.when(F.col("_crowd").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(low.cast("long"), high.cast("long"))))).drop("_crowd")
    at = F.when(F.col("pos") < 0, F.col("pos") + n).otherwise(F.col("pos"))
    sought = asked.withColumns({"_pos": at, "_b": bucket(at)}).join(crowded, F.col("_b") == F.col("_crowd"), "left")
    sought = sought.withColumn("_exact", F.when(F.col("_crowd").isNull(), F.lit(-1).cast("long")).otherwise(F.col("_pos"))).drop("_crowd")
    inside = (F.col("_b") == F.col("_bucket")) & (F.col("_exact") == F.col("_at")) & (F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_start") + F.col("size"))
    out = sought.join(named, inside).withColumn("local", F.col("_pos") - F.col("_start"))
    return out.select(*asked.columns, "part", "local")


def previous_episode(episodes: DataFrame, columns: list[str]) -> DataFrame:
    """``episodes`` with columns of the episode they follow, as ``prev_<column>``."""
    before = episodes.select(F.col("episode_index").alias("_prev"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return episodes.join(before, F.col("prev_episode_index") == F.col("_prev"), "left").drop("_prev")


def overridden(rows: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without the keys that ``overrides`` has, and these."""
    return rows.join(overrides.select(*key), key, "left_anti").unionByName(overrides)


def matched_once(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi join that keeps left rows with exactly one partner."""
    single = right.withColumn("_n", F.count("*").over(Window.partitionBy(*on))).where("_n = 1").drop("_n")
    return left.join(single, on)


def capped(episodes: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` episodes of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return episodes.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def steps_of(asked: DataFrame, episodes: DataFrame, stride: int = 1) -> DataFrame:
    """``asked`` (pos) with episode and step, where each of ``episodes`` (part, size) gives every ``stride``-th step."""
    sampled = episodes.withColumn("size", F.ceil(F.col("size") / stride).cast("long"))
    return routed(asked, sampled).withColumn("step", F.col("local") * stride).drop("local")


def texts_of(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, texts): all texts of a key in order."""
    every = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.transform(every, lambda s: s[text]).alias("texts"))


def transform_paths(edges: DataFrame, root: str, depth: int = 16) -> DataFrame:
    """(frame, matrix): each frame's 4 x 4 transform to ``root`` from (parent, child, matrix), row by row; a join for each level of the tree.

    Deeper trees than ``depth`` are refused. matrix is child to parent, 16 numbers in row order. Each level is a stored table, computed once.
    """
    from kinetrail.functions.geometry import product

    level = stored(edges.where(F.col("parent") == root).select(F.col("child").alias("frame"), "matrix"))
    out = level
    for _ in range(depth):
        below = edges.select("parent", "child", F.col("matrix").alias("_own"))
        level = stored(level.join(below, F.col("frame") == F.col("parent")).select(F.col("child").alias("frame"), product(F.col("matrix"), F.col("_own")).alias("matrix")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a tree of more than {depth} levels below {root}")
