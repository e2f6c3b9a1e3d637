"""Concat, merge with key remapping, repack and content identity of datasets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.features import agreed
from kinetrail.schema import INDEX, refuse_reserved
from kinetrail.tables import positions


def concatenated(datasets: list[DataFrame]) -> DataFrame:
    """All rows with ``dataset_index``; columns, types and features must be the same."""
    agreed(datasets)
    first = datasets[0]
    for df in datasets[1:]:
        if sorted(df.dtypes) != sorted(first.dtypes):
            raise ValueError("datasets differ in columns or types")
    if "dataset_index" in first.columns:
        refuse_reserved("dataset_index")
    return reduce(DataFrame.unionByName, [df.withColumn("dataset_index", F.lit(k)) for k, df in enumerate(datasets)])


def identity(*parts: Column) -> Column:
    """MD5 over parts, a null as the text None."""
    return F.md5(F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def merged_dimension(dims: list[DataFrame], key: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a new ``key``, map (dataset_index, old, new)): equal content is one row, in order of first appearance."""
    rows = concatenated(dims)
    mark = F.sha2(F.to_json(F.struct(*content)), 256)
    every = rows.withColumn("_mark", mark)
    first = every.groupBy("_mark").agg(F.min(F.struct("dataset_index", key, *content)).alias("_first"))
    numbered = positions(first.select("_mark", F.col("_first.dataset_index").alias("_d"), F.col(f"_first.{key}").alias("_k"), *[F.col(f"_first.{c}").alias(c) for c in content]), ["_d", "_k"], "_new")
    mapping = every.select("dataset_index", F.col(key).alias("old"), "_mark").join(numbered.select("_mark", F.col("_new").alias("new")), "_mark").drop("_mark")
    return numbered.select(F.col("_new").alias(key), *content), mapping


def remapped(frames: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """``frames`` (with dataset_index) with ``key`` mapped; nulls stay, an unknown key is an error."""
    m = mapping.select(F.col("dataset_index").alias("_d"), F.col("old").alias("_old"), F.col("new").alias("_to"))
    met = frames.join(m, (F.col("dataset_index") == F.col("_d")) & (F.col(key) == F.col("_old")), "left")
    lost = F.col(key).isNotNull() & F.col("_to").isNull()
    new = F.when(lost, F.raise_error(F.concat(F.lit(f"no mapping for {key} "), F.col(key).cast("string")))).otherwise(F.col("_to"))
    return met.withColumn(key, new).drop("_d", "_old", "_to")


def merged_episodes(episodes: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes renumbered in order of dataset and index, their map, frame offsets by dataset).

    Begin offsets move by the frames of the datasets before, -1 (unknown) stays; links to
    previous episodes are mapped and must lead to an earlier one.
    """
    rows = concatenated(episodes)
    sizes = rows.groupBy("dataset_index").agg(F.sum("frame_num").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.dataset_index") < F.col("a.dataset_index"), "left")  # a row for each dataset
    offsets = before.groupBy(F.col("a.dataset_index").alias("dataset_index")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("offset"))
    numbered = positions(rows, ["dataset_index", "episode_index"], "_new")
    mapping = numbered.select("dataset_index", F.col("episode_index").alias("old"), F.col("_new").alias("new"))
    linked = remapped(numbered, "prev_episode_index", mapping)
    late = F.col("prev_episode_index") >= F.col("_new")
    linked = linked.withColumn("prev_episode_index", F.when(late, F.raise_error(F.lit("a previous episode must come earlier"))).otherwise(F.col("prev_episode_index")))
    moved = linked.join(F.broadcast(offsets), "dataset_index")
    begin = F.when(F.col("dataset_begin_index") < 0, F.col("dataset_begin_index")).otherwise(F.col("dataset_begin_index") + F.col("offset"))
    out = moved.withColumn("dataset_begin_index", begin).withColumn("episode_index", F.col("_new")).drop("_new", "offset")
    return out, mapping, offsets


def repacked(frames: DataFrame, episodes: DataFrame, kept: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, episodes) of the chosen frames (``kept``: index), renumbered without gaps; of their own columns all or ``columns``.

    Episodes that stay complete keep success, truncated and info, and their previous link if
    that episode stayed complete too; others lose them.
    """
    if columns is not None:
        missing = set(columns) - set(frames.columns)
        if missing:
            raise ValueError(f"no columns {sorted(missing)}")
        frames = frames.select(*[c for c in frames.columns if c in INDEX or c in columns])
    some = frames.join(kept, "index", "left_semi")
    own = some.groupBy("episode_index").agg(F.count("*").alias("_n"))
    left = own.join(episodes, "episode_index").withColumn("_complete", F.col("_n") == F.col("frame_num"))
    numbered = positions(left, ["episode_index"], "_new", "_n", "_begin")
    before = numbered.select(F.col("episode_index").alias("_p"), F.col("_new").alias("_pnew"), F.col("_complete").alias("_pcomplete"))
    met = numbered.join(before, F.col("prev_episode_index") == F.col("_p"), "left")
    whole = F.col("_complete")
    out = met.select(
        F.col("_new").alias("episode_index"),
        F.when(whole & F.col("_pcomplete"), F.col("_pnew")).alias("prev_episode_index"),
        F.col("_begin").alias("dataset_begin_index"),
        F.col("_n").alias("frame_num"),
        *[F.when(whole, F.col(c)).alias(c) for c in ("truncated", "success", "info")],
    )
    from pyspark.sql import Window

    inside = Window.partitionBy("episode_index").orderBy("index")
    rows = some.withColumn("frame_index", (F.row_number().over(inside) - 1).cast("long")).join(numbered.select("episode_index", "_new", "_begin"), "episode_index")
    rows = rows.withColumn("index", F.col("_begin") + F.col("frame_index")).withColumn("episode_index", F.col("_new")).drop("_new", "_begin")
    return rows, out


def upgraded(table: DataFrame, version: int, steps: dict[int, Callable[[DataFrame], DataFrame]], current: int) -> DataFrame:
    """``table`` brought from ``version`` to ``current``, step by step; a newer table than the code is an error."""
    if version > current:
        raise ValueError(f"table version {version} is newer than {current}")
    for v in range(version, current):
        table = steps[v](table)
    return table


def merged_texts(rows: DataFrame, by: list[str], order: str, text: str, separator: str, target: str | None = None) -> DataFrame:
    """(keys, text, spans): texts joined in order with a separator, and where each one lies, from 0 and end exclusive.

    With ``target``, of texts that name the same target only the first is taken; those without one all are.
    """
    if target is not None:
        firsts = rows.where(F.col(target).isNotNull()).groupBy(*by, target).agg(F.min(F.struct(order, text)).alias("_first")).select(*by, "_first.*")
        rows = firsts.unionByName(rows.where(F.col(target).isNull()).select(*firsts.columns))
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    grouped = rows.groupBy(*by).agg(F.transform(listed, lambda r: r[text]).alias("_texts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    gap = len(separator)
    spans = F.aggregate(
        "_texts",
        start,
        lambda acc, t: F.struct((acc["at"] + F.length(t) + gap).alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(t)).alias("end")))).alias("spans")),
        lambda acc: acc["spans"],
    )
    return grouped.select(*by, F.array_join("_texts", separator).alias("text"), spans.alias("spans"))
