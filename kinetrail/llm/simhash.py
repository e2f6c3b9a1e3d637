"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into segments of 23, 23 and 18 bits (the last padded with
zeros). The perfect binary Golay code (23, 12, 7) has one codeword within 3 bits of every
23-bit word, and words within 2 bits of each other share a codeword that is within 4 bits of
both: the word halfway lies within 3 of it. So each segment is decoded to its codewords
within 4 bits, one or six 12-bit indices. Of ``max_bits`` = 4 differing bits, some two of
the three segments hold at most 2: a fingerprint's keys are the pairs of indices of two
segments, and no two fingerprints that link miss a shared key. Equal keys meet by a shuffle,
true distances decide, and linked fingerprints are united.

Only distinct fingerprints take part, so exact copies cost one row. Within a key the search
runs breadth first over what is not reached yet and returns one link for each fingerprint
reached, not all pairs. Keys are counted before they meet; the fingerprints of one with more
than RUN are dealt to blocks by hash, and each pair of blocks meets in a task of its own.

Null and empty texts have fingerprint zero and link like any other. Repeated rows and equal
doc_ids share a component by their fingerprints. A null doc_id comes after all others: its
component is the smallest id that it reaches, null if there is none. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, small, written

SEED = 42
MAX_BITS = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
RUN = 20_000
#: Keys with more fingerprints than RUN are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_KEYS = 100_000
_MADE: dict[str, np.ndarray] = {}
UPPER_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode().translate(UPPER_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
    starts = [0, *ends]
    n = max(len(words) - shingle + 1, 1)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends[-n:], strict=False)], ">u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        counts += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainders (syndromes, 11 bits) of 23-bit words by the generator polynomial."""
    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


def errors() -> np.ndarray:
    """For each syndrome, the error patterns of at most 4 bits: one, or six; -1 where there is no more."""
    if "errors" in _MADE:
        return _MADE["errors"]
    bits = 1 << np.arange(23)
    found = [np.zeros(1, np.int64)]
    last = [(0, -1)]
    for _ in range(4):
        last = [(p | int(bits[k]), k) for p, top in last for k in range(top + 1, 23)]
        found.append(np.array([p for p, _ in last], np.int64))
    patterns = np.concatenate(found)
    syndromes = _remainder(patterns)
    order = np.argsort(syndromes, kind="stable")
    patterns, syndromes = patterns[order], syndromes[order]
    place = np.arange(len(patterns)) - np.searchsorted(syndromes, syndromes)
    out = np.full((2048, 6), -1, np.int64)
    out[syndromes, place] = patterns
    return _MADE.setdefault("errors", out)


def indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within 4 bits of 23-bit words; -1 where there is no more."""
    wrong = errors()[_remainder(words)]
    return np.where(wrong < 0, -1, (words[:, None] ^ wrong) >> 11)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) for all keys of 64-bit fingerprints."""
    u = fps.view(np.uint64)
    found = [indices((u >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    rows, out = [], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = (found[i][:, :, None] << 12 | found[j][:, None, :]) | tag << 24
        good = (found[i][:, :, None] >= 0) & (found[j][:, None, :] >= 0)
        r, a, b = np.nonzero(good)
        rows.append(r)
        out.append(both[r, a, b])
    return np.concatenate(rows), np.concatenate(out)


def _emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy()
        for k in range(0, len(fps), 4096):
            part = fps[k : k + 4096]
            rows, key = keys(part)
            yield pd.DataFrame({"key": key.astype(np.int32), "fp": part[rows]})


def spanning(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links among distinct fingerprints: one for each that is reached."""
    a, b = [], []
    left = fps.view(np.uint64)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                reached = left[near]
                left = left[~near]
                queue.extend(reached)
                a.append(np.full(len(reached), x))
                b.append(reached)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)


def _links(max_bits: int, columns: list[str]):
    """Searches runs of equal ``columns``, which rows come sorted by; a run has a bounded number of rows."""

    def search(fresh: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        n = len(fp)
        a, b = [], []
        start = np.flatnonzero(fresh)
        group = np.cumsum(fresh)
        size = np.diff(np.r_[start, n])
        few = np.repeat(size <= 32, size)
        for step in range(1, min(32, n)):  # all pairs of short runs, a distance apart at a time
            same = few[:-step] & (group[step:] == group[:-step])
            if not same.any():
                break
            i = np.flatnonzero(same)
            i = i[np.bitwise_count((fp[i] ^ fp[i + step]).view(np.uint64)) <= max_bits]
            a.append(fp[i])
            b.append(fp[i + step])
        for s, m in zip(start[size > 32].tolist(), size[size > 32].tolist(), strict=True):
            x, y = spanning(fp[s : s + m], max_bits)
            a.append(x)
            b.append(y)
        none = np.empty(0, np.int64)
        a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, len(columns) + 1), np.int64)
        for batch in batches:  # the last run may go on in the next batch
            rows = np.vstack([held, batch[[*columns, "fp"]].to_numpy(np.int64)])
            fresh = np.r_[True, (rows[1:, :-1] != rows[:-1, :-1]).any(1)][: len(rows)]
            cut = int(np.flatnonzero(fresh)[-1]) if len(rows) else 0
            if cut:
                yield search(fresh[:cut], rows[:cut, -1])
            held = rows[cut:]
        if len(held):
            yield search(np.arange(len(held)) == 0, held[:, -1])

    return over


def link(classes: DataFrame, max_bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within ``max_bits``."""
    keyed = written(classes.select("fp").mapInPandas(_emit_keys, "key int, fp long"))
    hot = written(keyed.groupBy("key").count().where(F.col("count") > run).select(F.col("key").alias("hot"), F.ceil(F.col("count") * 2 / run).cast("int").alias("blocks")))
    out = "a long, b long"
    if not hot.count():
        met = keyed.repartition("key").sortWithinPartitions("key")
        return met.mapInPandas(_links(max_bits, ["key"]), out).distinct()
    hot = small(hot, BROADCAST_KEYS)
    met = keyed.join(hot, F.col("key") == F.col("hot"), "left_anti").repartition("key").sortWithinPartitions("key")
    direct = met.mapInPandas(_links(max_bits, ["key"]), out)
    dealt = keyed.join(hot, F.col("key") == F.col("hot")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # Two blocks of a key meet under their pair; a block meets itself in each of its pairs.
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
    pair = dealt.select("key", "fp", "block", F.explode(other).alias("other"))
    pair = pair.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")
    met = pair.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return direct.unionAll(met.mapInPandas(_links(max_bits, ["key", "low", "high"]), out)).distinct()


def grouped(docs: DataFrame, fp: Column) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row; component_id is the smallest doc_id in reach."""
    marked = written(docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), fp.alias("fp")))
    # Behind all ids: fingerprints without one, each by itself.
    nameless = (F.col("fp").cast("decimal(38,0)") + F.lit(str(1 << 65)).cast("decimal(38,0)")).cast("decimal(38,0)")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").cast("decimal(38,0)").alias("rep")).withColumn("rep", F.coalesce("rep", nameless)))
    links = link(classes)
    ends = written(
        links.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a")
        .join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
        .select("ra", "rb")
    )
    found = components(ends, "ra", "rb")
    united = written(
        classes.join(found, F.col("rep") == F.col("node"), "left")
        .withColumn("top", F.coalesce("component", "rep"))
        .select(F.col("fp").alias("_fp"), F.when(F.col("top") < F.lit(str(1 << 63)).cast("decimal(38,0)"), F.col("top")).cast("long").alias("component_id"))
    )
    return marked.join(united, F.col("fp") == F.col("_fp")).drop("_fp")


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = grouped(docs, fingerprints(docs["text"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, all columns; of rows that share it, one."""
    found = grouped(docs, fingerprints(docs["text"]))
    first = Window.partitionBy("doc_id", "component_id").orderBy("text_hash")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).distinct().withColumn("n", F.row_number().over(first)).where("n = 1")
    keys = written(kept.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("h", F.xxhash64("row.text"))
    met = rows.join(keys.withColumnRenamed("h", "_h"), F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("_h")))
    alike = Window.partitionBy("d", "h").orderBy(F.lit(0))
    return met.withColumn("n", F.row_number().over(alike)).where("n = 1").select("row.*")
