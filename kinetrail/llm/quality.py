"""Quality rules: hashed n-gram log-likelihood ratios between a trusted and the raw corpus.

Words and word pairs of every text are hashed into ``buckets`` multinomial cells. One pass
counts the cells over all documents and over the trusted ones; the log ratio of the trusted
count to the count expected from the raw distribution, ``smoothing`` words added to both, becomes a dense weight array, whose size depends on ``buckets`` alone. A
document's score is the mean weight of its cells, and it is kept at ``threshold`` or more,
unless the base rules fail it. Everything is DataFrame expressions.

Nulls, empty texts: no words, score 0, base_failed. Repeated rows count once each in the
corpus statistics and are judged alike. Labels of unknown documents are unused; an empty or
unlabelled corpus has weight 0 in every cell, so that only the base rules decide.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, let, small, words_of, written

BUCKETS = 1 << 16
SMOOTHING = 10.0
THRESHOLD = -0.1
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: Trusted ids are broadcast up to this many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def _shifted(words: Column, n: int) -> Column:
    """Each word with the n - 1 after it, nulls behind the last."""
    return F.arrays_zip(*[F.slice(words, k, F.greatest(F.size(words) - k + 1, F.lit(0))) for k in range(1, n + 1)])


def _cells(pair: Column, buckets: int) -> tuple[Column, Column]:
    """The cell of a word, and that of it with the next word."""
    mask = F.lit(buckets - 1).cast("long")
    return F.xxhash64(pair["0"]).bitwiseAND(mask).cast("int"), (F.xxhash64(pair).bitwiseAND(mask) + buckets).cast("int")


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: ``weights array<double>``, the log ratio of each cell. trusted: ids (doc_id) of trusted documents."""
    ids = small(written(trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()), BROADCAST_IDS)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    marked = texts.join(ids, F.col("_doc") == F.col("_id"), "left").select(F.col("_id").isNotNull().cast("long").alias("t"), "_text")
    pairs = marked.select("t", F.explode(let(words_of(F.col("_text")), lambda w: _shifted(w, 2))).alias("p"))
    cells = pairs.select("t", *[c.alias(n) for c, n in zip(_cells(F.col("p"), buckets), ("one", "two"), strict=True)])
    both = cells.groupingSets([["one"], ["two"]], "one", "two").agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
    counts = written(both.select(F.coalesce("one", "two").alias("cell"), "raw", "good"))
    total = counts.agg(F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good")).first()
    share = (total["n_good"] or 0) / (total["n_raw"] or 1)
    weight = F.log(F.col("good") + smoothing) - F.log(F.col("raw") * share + smoothing) if share else F.lit(0.0)
    every = docs.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("cell"))
    dense = every.join(counts.select("cell", weight.alias("w")), "cell", "left").select("cell", F.coalesce("w", F.lit(0.0)).alias("w"))
    ordered = F.sort_array(F.collect_list(F.struct("cell", "w")))
    return written(dense.agg(F.transform(ordered, lambda x: x["w"]).alias("weights")))


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that the text has twice or more."""
    n = F.size(words)
    windows = F.transform(F.slice(_shifted(words, 5), 1, n - 4), lambda five: F.xxhash64(five))

    def covered(ws: Column) -> Column:
        placed = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, i: (i > 0) & (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )

        def spread(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1) - p, F.lit(5)))), F.lit(0), lambda acc, x: acc + x
            )

        many = let(let(placed, twice), lambda t: let(F.sort_array(F.transform(t, lambda x: x["i"])), spread))
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(many)

    return F.when(n < 5, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def judged(text: Column, weights: Column, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> Column:
    """Struct of the base counts, base_failed, kept and score for one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))

    def weight(pair: Column) -> Column:
        one, two = _cells(pair, buckets)
        return F.get(weights, one) + F.get(weights, two)

    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")

    def parts(words: Column) -> Column:
        n = F.size(words)
        total = F.aggregate(F.transform(_shifted(words, 2), weight), F.lit(0.0), lambda acc, x: acc + x)
        first = F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
            F.when(n == 0, F.lit(0.0)).otherwise(total / (2 * n)).alias("score"),
        )
        return let(first, whole)

    def whole(s: Column) -> Column:
        failed = (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)
        return F.struct(
            s["n_words"].alias("n_words"),
            s["word_chars"].alias("word_chars"),
            F.when(text.rlike(f"[{SYMBOLS}]"), symbols).otherwise(F.lit(0).cast("long")).alias("n_symbols"),
            let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            s["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (s["score"] >= threshold)).alias("kept"),
            s["score"].alias("score"),
        )

    return let(words_of(text), parts)


def _with_weights(docs: DataFrame, trusted: DataFrame, name: str) -> DataFrame:
    """``docs`` with the weights as a constant column: a scalar subquery, inlined where it is used."""
    return docs.withColumn(name, fit(docs, trusted).scalar())


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document's doc_id, base counts, base_failed, kept and score."""
    weighed = _with_weights(docs.select("doc_id", "text"), trusted, "_weights")
    return weighed.select("doc_id", judged(F.col("text"), F.col("_weights"), threshold=threshold).alias("q")).select("doc_id", "q.*")


def keep(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, all columns."""
    name = f"_weights_{uuid4().hex}"
    weighed = _with_weights(docs, trusted, name)
    return weighed.where(judged(weighed["text"], weighed[name], threshold=threshold)["kept"]).drop(name)
