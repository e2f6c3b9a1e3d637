"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code point order (null last) get the weights in turn; targets share ``share`` of
all sizes by weight, and stop at ``most`` times their source's size (the rest is reshared, in
closed form over sources sorted by the ratio of limit to weight). A target is cut into blocks
of ``block`` tokens, apportioned to sources, each source's blocks to its groups of ``GROUP`` shards
and a group's to its shards, by the highest quotients votes / (2k - 1). A shard holds the
source's documents whose seeded hash falls to it, about ``shard`` tokens, laid end to end in
hash order. Its quota takes all blocks as often as it can, and the rest is a run of blocks that
begins at a seeded one and goes on at the first behind the last: documents lie there in random
order, and all but those at the run's ends are taken whole. A quota is at most twice a shard's
blocks; what rounding gives beyond that, less than a block, is not taken.

Sources are cut into shards by hash, so a source with most of the rows is many tasks.
Null sources are a source of their own, a null doc_id is like any other, null and empty texts have size 0 and take 0; repeated
rows are laid one after the other. Without sizes all targets are 0. Reruns agree: the order is by
a hash of doc_id and text, and rows that tie in it are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, n_words_of, small, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 16
SHARD = 200_000
SEED = 7
#: Shards that are ranked together; so are a source's groups.
GROUP = 1_000
#: Shard and source rows are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_ROWS = 20_000


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) with weight and target; one row for each source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    weighed = (
        sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (turn - 1) % len(weights)).cast("double"))
        .withColumn("limit", F.col("size") * float(most))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("wanted", F.sum("size").over(total) * share)
        .withColumn("all_weight", F.sum("weight").over(total))
    )
    level = (F.col("wanted") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    capped = weighed.withColumn("capped", F.col("ratio") <= level)
    rest = F.col("wanted") - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(total)
    open_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(total)
    return capped.withColumn(
        "target", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * rest / open_weight)
    ).select("source", "size", "weight", "target")


def sainte_lague(votes: DataFrame, group: list[str], vote: str, seats: Column, order: list[str]) -> DataFrame:
    """``votes`` with ``quota``: ``seats`` of each group given to its rows by highest quotients.

    With d votes a seat, rounding v / d gives a sum off by at most half a seat a row. The divisor
    that gives the right sum therefore lies within rows / 2 seats of d, and a row's quota within
    v * rows / (2 * all votes) + 1 of its rounded one: only those quotients are ranked, at most
    three a row on average. Ties go by ``order``.
    """
    of = Window.partitionBy(*group)
    d = F.sum(vote).over(of) / F.greatest(seats, F.lit(1))
    sure = votes.withColumn("_d", d).withColumn("_seats", seats)
    sure = sure.withColumn("_n", F.when(F.col("_d") > 0, F.floor(F.col(vote) / F.col("_d") + 0.5)).otherwise(0).cast("long"))
    reach = F.floor(F.col(vote) * F.count("*").over(of) / (2 * F.greatest(F.sum(vote).over(of), F.lit(1)))).cast("int") + 2
    sure = sure.withColumn("_diff", F.col("_seats") - F.sum("_n").over(of)).withColumn("_reach", reach)
    each = sure.withColumn("_k", F.explode(F.sequence(F.lit(1), "_reach")))
    given = F.col(vote) / (2 * (F.col("_n") + F.col("_k")) - 1)
    lost = F.when(F.col("_k") <= F.col("_n"), F.col(vote) / (2 * (F.col("_n") - F.col("_k")) + 1)).otherwise(F.lit(float("inf")))
    more, less = of.orderBy(given.desc(), *order, "_k"), of.orderBy(lost, *[F.col(c).desc() for c in order], "_k")
    step = F.when((F.col("_diff") > 0) & (F.row_number().over(more) <= F.col("_diff")), 1).when(
        (F.col("_diff") < 0) & (F.row_number().over(less) <= -F.col("_diff")), -1
    )
    stepped = each.withColumn("_step", step)
    return stepped.groupBy(*votes.columns, "_n").agg(F.coalesce(F.sum("_step"), F.lit(0)).alias("_s")).withColumn("quota", F.col("_n") + F.col("_s")).drop("_n", "_s")


def _measured(docs: DataFrame, row: list[str], seed: int) -> DataFrame:
    """``row`` columns as a struct, source, size and the hash that orders documents."""
    return docs.select(
        F.struct(*[docs[c] for c in row]).alias("row"),
        docs["source"].alias("source"),
        n_words_of(docs["text"]).alias("size"),
        F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("hash"),
    )


def _mixed(sized: DataFrame, every: DataFrame, seed: int, block: int, shard: int) -> DataFrame:
    """``every`` with source_size, target, full (whole passes), taken and how to tell chosen blocks."""
    sources = targets(written(sized.groupBy("source").agg(F.sum("size").alias("size"))))
    sources = sources.withColumn("blocks", F.greatest(F.round(F.sum("target").over(Window.partitionBy()) / block), F.lit(0)).cast("long"))
    sources = written(
        sainte_lague(sources.withColumn("one", F.lit(1)), ["one"], "target", F.col("blocks"), ["source"])
        .withColumn("shards", F.greatest(F.ceil(F.col("size") / shard), F.lit(1)).cast("long"))
        .select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", F.col("quota").alias("source_quota"), "shards")
    )
    sources = small(sources, BROADCAST_ROWS)

    def placed(rows: DataFrame) -> DataFrame:
        met = rows.join(sources, F.col("source").eqNullSafe(F.col("_source")))
        return met.withColumn("shard", F.pmod(F.shiftright("hash", 20), F.col("shards")))

    keys = ["_source", "shard"]
    totals = written(placed(sized).groupBy(*keys).agg(F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota")))
    totals = totals.withColumn("group", F.floor(F.col("shard") / GROUP))
    groups = totals.groupBy("_source", "group").agg(F.sum("shard_size").alias("group_size"), F.max("source_quota").alias("source_quota"))
    groups = sainte_lague(groups, ["_source"], "group_size", F.col("source_quota"), ["group"])
    groups = written(groups.select(F.col("_source").alias("gsource"), F.col("group").alias("ggroup"), F.col("quota").alias("group_quota")))
    totals = totals.join(groups, F.col("_source").eqNullSafe(F.col("gsource")) & (F.col("group") == F.col("ggroup"))).drop("gsource", "ggroup")
    quotas = sainte_lague(totals, ["_source", "group"], "shard_size", F.col("group_quota"), ["shard"])
    quotas = written(
        quotas.withColumn("n_blocks", F.ceil(F.col("shard_size") / block).cast("long"))
        .withColumn("quota", F.least(F.col("quota"), MOST * F.col("n_blocks")))
        .select(*[F.col(c).alias(f"q{c}") for c in keys], "n_blocks", "quota")
    )
    laid = Window.partitionBy("_source", "shard").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed(every).withColumn("start", F.coalesce(F.sum("size").over(laid), F.lit(0)).cast("long"))
    met = at.join(small(quotas, BROADCAST_ROWS), F.col("_source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("qshard")))
    met = (
        met.withColumn("n_blocks", F.greatest("n_blocks", F.lit(1)))  # a shard without words takes none
        .withColumn("rest", F.pmod("quota", "n_blocks"))
        .withColumn("offset", F.pmod(F.xxhash64(F.lit(seed), "_source", "shard"), F.col("n_blocks")))
        .withColumn("full", F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("quota") / F.col("n_blocks"))).cast("long"))
    )
    end = F.col("start") + F.col("size")
    mine = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    part = F.aggregate(
        F.filter(mine, _chosen), F.lit(0).cast("long"), lambda acc, b: acc + F.least(end, (b + 1) * block) - F.greatest(F.col("start"), b * block)
    )
    part = F.when(F.col("size") == 0, F.lit(0)).otherwise(part)
    return met.withColumn("taken", (F.col("full") * F.col("size") + part).cast("long"))


def _chosen(block: Column) -> Column:
    return F.pmod(block - F.col("offset"), F.col("n_blocks")) < F.col("rest")


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    sized = written(_measured(docs, ["doc_id"], seed))
    done = _mixed(sized, sized, seed, block, shard)
    return done.select("row.doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix itself, columns of ``docs``: a row for each whole pass over a document, and one with
    the words of its further chosen blocks, with what stands between them. Documents that nothing is taken of go."""
    sized = written(_measured(docs, ["doc_id"], seed))
    done = _mixed(sized, _measured(docs, docs.columns, seed), seed, block, shard)
    parted = F.split(F.ltrim(F.col("row.text"), F.lit(SPACE_CHARS)), f"(?<=[{SPACES}])(?=[^{SPACES}])")  # words with the white characters behind them
    words = F.filter(parted, lambda w, i: _chosen(F.floor((F.col("start") + i) / block)))
    part = F.col("taken") - F.col("full") * F.col("size")
    text = F.when(part == F.col("size"), F.col("row.text")).otherwise(F.rtrim(F.array_join(words, ""), F.lit(SPACE_CHARS)))
    more = F.when(part > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col("row.text"), F.col("full").cast("int")), more)
    rows = done.select("row", F.explode(texts).alias("text"))
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
