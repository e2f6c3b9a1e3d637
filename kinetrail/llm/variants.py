"""Spelling variants: words of a corpus that differ by one character from a far more frequent word.

Words are counted within tasks before they are shuffled. Two words one edit apart share a bigram among the three rarest of each
(an edit destroys two bigrams of a word at most, so that of a word's three rarest one is left, and the one that comes first
in the global order of all that are left lies in both threes). The global order is by a bigram's number of words, then the bigram, then its position.

A shared bigram that the edit leaves whole has the edit behind it or before it. So either both words are equal up to
and with the bigram, which stands at the same position, or from the bigram on, and its positions differ as the
lengths do, by one at most. A word's key is therefore a rare bigram's position, counted from that end, with
the text on that side, and the other word's length. Words meet by equal keys, pairs are verified by Levenshtein distance, and distinct pairs remain.

A word's form is its near word of largest count, if at least ``TIMES`` its own; a root is where forms lead, found by doubling steps
(counts grow along them, so that there are no circles).

Null and empty texts have no words. A null doc_id is the empty string in what is hashed. Repeated rows count each. Empty tables give an empty
result. Extra columns are not read. Words may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
#: One run in so many, by a hash of document and run, loses a character.
ONE_IN = 199
RAREST = 3
HELD = 300_000


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters, only A-Z lower-cased, one in ONE_IN with a character deleted, that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A code point over U+00FF becomes '?', which is no letter of a run; so a byte is a code point.
        runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)
        tally: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array([w.decode("latin-1") for w in tally], pa.string()), "n": pa.array(tally.values(), pa.int64())})
            tally.clear()
            return out

        for batch in batches:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                begun = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(runs.findall(text.decode("utf-8", "replace").encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                    if h % ONE_IN == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    tally[run] += n
                if len(tally) > HELD:
                    yield rows()
        yield rows()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigrams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))


def _keys(words: DataFrame) -> DataFrame:
    """word, n, size, side, text: for each of a word's three rarest bigrams what stands up to it and what stands from it on."""
    spark = words.sparkSession
    counts = words.select(F.explode(F.array_distinct(bigrams(F.col("word")))).alias("gram")).groupBy("gram").count()
    # 90 letters after lower-casing: at most 8100 bigrams.
    rank = spark.sparkContext.broadcast({r.gram: k for k, r in enumerate(sorted(counts.collect(), key=lambda r: (r["count"], r.gram)))})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                for _, at in sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))[:RAREST]:
                    for side, text in ((0, word[: at + 2]), (1, word[at:])):
                        for to, x in zip(out, (word, n, len(word), side, text), strict=True):
                            to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["word", "n", "size", "side", "text"])

    return words.select("word", "n").mapInArrow(keys, "word string, n long, size int, side int, text string")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: distinct pairs of words exactly one edit apart, each once."""
    keys = written(_keys(words))
    key = lambda size: F.xxhash64("side", size, "text").alias("key")
    held = keys.select(key(F.col("size")), F.col("word").alias("b"), F.col("n").alias("b_n"))
    # A word asks those of its own length, and those one longer.
    asked = keys.select(F.explode(F.array("size", F.col("size") + 1)).alias("size"), "side", "text", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("own"))
    asked = asked.select(key(F.col("size")), "a", "a_n", (F.col("own") == F.col("size")).alias("same"))
    met = asked.join(held, "key").where((~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """node, root: where following ``word`` -> ``form`` ends, for every word that has a form."""
    now = written(forms.select(F.col("word").alias("node"), F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        step = now.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        now = written(now.join(step, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
    return now.select("node", "root")


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = written(word_counts(docs))
    pairs = written(near_pairs(words))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("_word"), "a_n").agg(F.count("*").alias("near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("b"))).alias("best"))
    enough = -F.col("best.less") >= F.lit(times) * F.col("a_n")
    best = written(best.select("_word", "near", F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(best.where("form is not null").select(F.col("_word").alias("word"), "form"))
    met = words.join(best, F.col("word") == F.col("_word"), "left").join(ends, F.col("word") == F.col("node"), "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
