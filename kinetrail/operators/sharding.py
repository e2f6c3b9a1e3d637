"""Shards, resampling to exact counts, worker quotas, shuffles, strides and batches, all as arithmetic on positions."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.tables import positions, stored


def counted(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count("*").alias("n")).scalar()


def contiguous_shard(pos: Column, n: Column, shards: int) -> Column:
    """Shard of a position: sizes differ by one at most, the first n % shards are larger."""
    small = F.floor(n / shards)
    big = n % shards
    cut = big * (small + 1)
    return F.when(pos < cut, F.floor(pos / (small + 1))).otherwise(big + F.floor((pos - cut) / F.greatest(small, F.lit(1)))).cast("long")


def sharded(df: DataFrame, shards: int, contiguous: bool = True, strategy: str | None = None, pos: str = "pos") -> DataFrame:
    """``df`` with ``shard``. strategy: None, ``drop_last`` (shards of equal size, the rest goes) or ``pad_last`` (the head again fills the last)."""
    n = df.count()
    if strategy == "drop_last":
        if n < shards:
            raise ValueError("drop_last would drop every row")
        df, n = df.where(F.col(pos) < n - n % shards), n - n % shards
    elif strategy == "pad_last":
        if not n:
            raise ValueError("an empty table cannot be padded")
        more = -n % shards
        turns = F.explode(F.sequence(F.lit(0), F.lit(-(-more // n))))
        again = df.withColumn("_turn", turns).where((F.col("_turn") > 0) & (F.col(pos) + (F.col("_turn") - 1) * n < more))
        again = again.withColumn(pos, F.col(pos) + F.col("_turn") * n).drop("_turn")
        df, n = df.unionByName(again), n + more
    return df.withColumn("shard", contiguous_shard(F.col(pos), F.lit(n), shards) if contiguous else (F.col(pos) % shards).cast("long"))


def nested_shard(shards: int, shard: int, inner_shards: int, inner_shard: int) -> tuple[int, int]:
    """(shards, shard) of an inner shard of a shard."""
    return shards * inner_shards, shard * inner_shards + inner_shard


def target_rows(n: int, ratio: float) -> int:
    """round(n * ratio), half to even."""
    if isinstance(ratio, bool) or not math.isfinite(ratio) or ratio <= 0:
        raise ValueError("the ratio must be finite and positive")
    return round(n * ratio)


def resampled(df: DataFrame, ratio: float, seed: int, key: str = "pos") -> DataFrame:
    """Exactly round(n * ratio) rows: whole passes, and one partial pass in a seeded order; ``pass`` tells which."""
    n = df.count()
    whole, rest = divmod(target_rows(n, ratio), n) if n else (0, 0)
    full = df.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(whole)))) if whole else df.withColumn("pass", F.lit(0)).where("false")
    ranked = positions(df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key))), ["_hash", key], "_rank")
    return full.unionByName(ranked.where(F.col("_rank") < rest).drop("_rank", "_hash").withColumn("pass", F.lit(whole + 1)))


def worker_quotas(shards: DataFrame, base: str, target: str) -> DataFrame:
    """``shards`` (worker, base rows, total target) with ``quota``: target shared in proportion by largest remainders, ties to the lower worker."""
    all_rows = Window.partitionBy()  # a row for each worker
    whole = F.floor(F.col(target) * F.col(base) / F.sum(base).over(all_rows)).cast("long")
    rest = (F.col(target) * F.col(base)) % F.sum(base).over(all_rows)
    cut = shards.withColumn("_whole", whole).withColumn("_rest", rest)
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), "worker"))
    more = (rank <= F.col(target) - F.sum("_whole").over(all_rows)).cast("long")
    return cut.withColumn("quota", F.col("_whole") + more).drop("_whole", "_rest")


def shuffled(df: DataFrame, seed: int, key: str = "pos", chunk: int | None = None) -> DataFrame:
    """``df`` with ``shuffled``, its place in a seeded order; with ``chunk``, chunks move as a whole and rows within them."""
    marked = df.withColumn("_chunk", F.xxhash64(F.lit(seed), F.floor(F.col(key) / chunk)) if chunk else F.lit(0)).withColumn("_hash", F.xxhash64(F.lit(seed + 1), F.col(key)))
    return positions(marked, ["_chunk", "_hash", key], "shuffled").drop("_chunk", "_hash")


def mixed(sources: list[DataFrame], weights: list[float], seed: int, key: str = "pos") -> DataFrame:
    """All rows of the sources with ``source`` and ``mix_key``: in its order, a draw of a source by its weight each time, until it is empty.

    Row r of n rows in a source's seeded order comes at time (r + u) / weight, u uniform in [0, 1), so that sources advance at rates
    of their weights for as long as they have rows; a rank within a source is a place by range partition.
    """
    out = None
    for k, (df, weight) in enumerate(zip(sources, weights, strict=True)):
        drawn = positions(df.withColumn("_hash", F.xxhash64(F.lit(seed), F.lit(k), F.col(key))), ["_hash", key], "_rank")
        u = F.pmod(F.xxhash64(F.col("_hash"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        one = drawn.withColumn("source", F.lit(k)).withColumn("mix_key", (F.col("_rank") + u) / float(weight)).drop("_hash", "_rank")
        out = one if out is None else out.unionByName(one)
    return out


def active_mix(rows: DataFrame, source: str, order: list[str], active: int, seed: int | None = None) -> DataFrame:
    """``rows`` of many sources with ``mix_pos``, their place in a mix that has at most ``active`` sources open at a time.

    Each draw takes the next row of one of the open sources, with weights in proportion to their whole numbers of rows; when a draw finds
    its source empty, the next source of the list opens in its place. Draws of such weights are what independent arrivals at
    such rates give: a source of n rows that opens at time s has its r-th row at s + (g1 + ... + gr) / n, with exponential gaps g, and is
    found empty at the arrival behind its last row. So a source's times are prefix sums over its rows by range partition, the times at which
    sources open are a fold over the sources (a row a source on the driver), and the mix is the order of all times.

    With ``seed``, sources and the rows of each are shuffled, and gaps are drawn, all by hashes; without it, sources open by name, rows
    come in ``order``, gaps are 1, and with ``active`` 1 sources follow one another. Equal times go by the sources' places. A null source is a
    source, the last. ``order`` must tell a source's rows apart for reruns to agree.
    """
    if active < 1:
        raise ValueError("at least one source must be active")
    hashed = lambda *c: F.xxhash64(F.lit(seed), *c)
    gap = F.lit(1.0) if seed is None else -F.log((F.pmod(hashed(F.lit("gap"), source, *order), F.lit(1 << 52)) + 1) / float(1 << 52))
    end_gap = F.lit(1.0) if seed is None else -F.log((F.pmod(hashed(F.lit("end"), source), F.lit(1 << 52)) + 1) / float(1 << 52))
    place = F.lit(0) if seed is None else hashed(F.lit("source"), source)
    marked = rows.withColumns({"_none": F.col(source).isNull(), "_hash": F.lit(0) if seed is None else hashed(source, *order), "_gap": gap})
    timed = stored(positions(marked, ["_none", source, "_hash", *order], "_row", "_gap", "_before"))
    sums = timed.groupBy(source).agg(F.count("*").alias("n"), F.min("_before").alias("base"), F.sum("_gap").alias("gaps"))
    each = sums.select(F.col(source).alias("_source"), "n", "base", ((F.col("gaps") + end_gap) / F.col("n")).alias("lasts"), place.alias("_place"), F.col(source).isNull().alias("_none"))
    known = each.orderBy("_place", "_none", "_source").collect()  # a row a source
    free = [0.0] * active
    opened = []
    for k, r in enumerate(known):
        start = heapq.heappop(free)
        heapq.heappush(free, start + r.lasts)
        opened.append((r["_source"], k, r.n, r.base, start))
    kind = rows.schema[source].dataType.simpleString()
    starts = rows.sparkSession.createDataFrame(opened, f"_source {kind}, _k long, _n long, _base double, _start double")
    met = timed.join(starts, F.col(source).eqNullSafe(F.col("_source")))
    met = met.withColumn("_time", F.col("_start") + (F.col("_before") - F.col("_base") + F.col("_gap")) / F.col("_n"))
    return positions(met.select(*rows.columns, "_time", "_k", "_row"), ["_time", "_k", "_row"], "mix_pos").drop("_time", "_k", "_row")


def mix_summary(mix: DataFrame) -> DataFrame:
    """(source, n_rows, share) of a mix."""
    rows = mix.groupBy("source").agg(F.count("*").alias("n_rows"))
    return rows.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def evenly_spaced(df: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    """``k`` rows at places floor(i * n / k), with ``take``; more than there are go round."""
    n = df.count()
    asked = df.sparkSession.range(k if n else 0).select(F.col("id").alias("take"), (F.floor(F.col("id") * n / k) if k <= n else F.col("id") % max(n, 1)).alias("_at"))
    return asked.join(df, F.col("_at") == F.col(pos)).drop("_at")


def flag_batches(df: DataFrame, flag: str, size: int, order: str = "pos") -> DataFrame:
    """``df`` with ``batch`` and ``slot``: all rows of a batch share a flag. A last short batch repeats its flag's first rows."""
    # Places in the order of (flag, order), less the flag's first: no flag is one task.
    numbered = positions(df, [flag, order], "_n")
    count = numbered.groupBy(F.col(flag).alias("_flag")).agg(F.count("*").alias("_count"), F.min("_n").alias("_n0"))
    met = numbered.join(count, F.col(flag).eqNullSafe(F.col("_flag"))).withColumn("_n", F.col("_n") - F.col("_n0")).drop("_flag", "_n0")
    # Row j fills every place i with i % count = j, up to a whole number of batches.
    full = F.ceil(F.col("_count") / size) * size
    places = F.sequence(F.col("_n").cast("long"), full - 1, F.col("_count"))
    out = met.withColumn("_place", F.explode(places))
    return out.withColumn("batch", F.floor(F.col("_place") / size)).withColumn("slot", F.col("_place") % size).drop("_n", "_count", "_place")


def collated(df: DataFrame, batch: str, column: str, order: str) -> DataFrame:
    """(batch, rows): arrays of a batch padded with zeros to the longest."""
    rows = F.array_sort(F.collect_list(F.struct(order, column)))
    grouped = df.groupBy(batch).agg(F.transform(rows, lambda r: r[column]).alias("rows"), F.max(F.size(column)).alias("_w"))
    return grouped.select(batch, F.transform("rows", lambda a: F.concat(a, F.array_repeat(F.lit(0.0), F.col("_w") - F.size(a)))).alias("rows"))


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """About the bytes of a row: 8 a number, the length of texts and binaries, and the sum over arrays, maps and structs."""
    from pyspark.sql import types as T

    def of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(value).cast("long"), F.lit(0))
        if isinstance(kind, T.StructType):
            return sum((of(value[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.NumericType | T.BooleanType | T.DatetimeType):
                return F.coalesce(F.size(value).cast("long") * 8, F.lit(0))
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + of(x, kind.elementType)), F.lit(0))
        if isinstance(kind, T.MapType):
            return of(F.map_keys(value), T.ArrayType(kind.keyType)) + of(F.map_values(value), T.ArrayType(kind.valueType))
        return F.lit(8).cast("long")

    return sum((of(F.col(c), df.schema[c].dataType) for c in columns or df.columns), F.lit(0).cast("long"))


def byte_shards(df: DataFrame, limit: int, order: list[str], size: Column | None = None) -> DataFrame:
    """``df`` with ``bytes`` and ``shard``: consecutive rows in ``order`` of at most ``limit`` bytes in sum, but for one larger row at a shard's end.

    A shard is where a row's prefix sum falls in steps of the limit less the largest row; rows over half the limit do not count for that, so that
    one of them may overrun its shard, by itself alone. Sums are made by range partition. Shards may be empty and have no number then.
    """
    if limit < 1:
        raise ValueError("the limit must be a byte at least")
    sized = df.withColumn("bytes", row_bytes(df) if size is None else size.cast("long"))
    laid = positions(sized, order, "_row", "bytes", "_before")
    largest = laid.agg(F.coalesce(F.max(F.when(F.col("bytes") <= limit // 2, F.col("bytes"))), F.lit(0))).first()[0]
    return laid.withColumn("shard", F.floor(F.col("_before") / (limit - largest)).cast("long")).drop("_row", "_before")


def sharded_rows(n: int, shards: int, shard: int, strategy: str | None = None) -> int:
    """How many rows ``sharded`` gives a shard, without a scan."""
    if strategy == "drop_last":
        return n // shards
    if strategy == "pad_last":
        return -(-n // shards)
    return n // shards + (shard < n % shards)


def shard_rows(n: Column, shards: int, shard: Column, strategy: str | None = None) -> Column:
    """``sharded_rows`` for a column of sizes and one of shards."""
    whole, more = F.floor(n / shards), n % shards
    return (whole if strategy == "drop_last" else F.ceil(n / shards) if strategy == "pad_last" else whole + (shard < more).cast("long")).cast("long")


def batch_count(n: Column, size: int, drop_last: bool = False) -> Column:
    """Batches that n rows of a worker make."""
    return F.floor(n / size) if drop_last else F.ceil(n / size)


def reservoir_shuffled(df: DataFrame, reservoir: int, take: int, seed: int) -> DataFrame:
    """Each partition's rows in a bounded shuffle: ``reservoir`` rows are held, ``take`` more are read, and ``take`` random ones of all go on."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def shuffle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held = None
        for batch in batches:
            for k in range(0, len(batch), take):
                part = batch.iloc[k : k + take]
                held = part if held is None else pd.concat([held, part], ignore_index=True)
                if len(held) > reservoir:
                    order = rng.permutation(len(held))
                    yield held.iloc[order[reservoir:]]
                    held = held.iloc[order[:reservoir]]
        if held is not None:
            yield held.iloc[rng.permutation(len(held))]

    return df.mapInPandas(shuffle, df.schema)
