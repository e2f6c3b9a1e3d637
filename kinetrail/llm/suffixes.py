"""Exact substring dedup by a sparse, partitioned suffix array.

Every byte is removed that a string of ``LENGTH`` bytes covers which also starts elsewhere. Not
all suffixes are sorted, only those at anchors. The anchor of a window of LENGTH bytes is its
``GRAM``-byte substring with the smallest hash, the leftmost of equal ones. It depends on the
window alone, so that equal windows have anchors in the same place, and one in about a hundred
suffixes is one. A suffix carries which windows have it as their anchor.

1. Suffixes are range-partitioned by sampled splitters of their leading tokens (the first eight
   bytes, the gram, the context that its windows cover); ties go on by document and place, so that
   a hot passage spreads over partitions. Each bucket sorts locally by multikey quicksort.
   Suffixes that share no gram with a neighbour are done: none of their windows repeats. Equal
   whole contexts repeat in all their windows. The first and last group of every bucket may go
   on in the next one and are compared across boundaries in a further step.
2. Groups with different contexts are cut by window offset into blocks of ``WIDTH``; a block's
   windows share LENGTH - WIDTH + 1 bytes, whose hash is the key, so that near copies that differ
   in them part again. Texts of such groups' documents give the bytes, windows with equal
   hashes at one offset are repeats. A key of more than ``TOGETHER`` blocks does not meet in one
   task: its windows are counted by their hashes in a grouping of their own.
3. Repeated windows' spans are united per document, and the rest of its bytes is kept.

Texts are UTF-8, null is empty, and a null doc_id stays null. Repeated rows, even with one doc_id, are occurrences of their
own: a document is told by doc_id and a hash of its text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, small, written

LENGTH = 200
GRAM = 32
WIDTH = 43
#: Bytes of a text that are looked at at once; the windows of one part begin in it.
PART = 1 << 22
#: Suffixes that a range bucket holds in memory, about (64 bytes each).
BUCKET = 1_000_000
#: Blocks under one key that are compared in one task (about 2 KB each); those of larger keys are counted window by window.
TOGETHER = 20_000
BROADCAST_KEYS = 100_000
BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Stands for a null doc_id; a document is told by its text too, so that one of this id and text has the same result.
NAMELESS = -(1 << 63)
PLACE = np.uint64((1 << 24) - 1)


def rolled(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes (modulo 2^64) of all substrings of ``width`` along the last axis, by doubling."""
    power, have, out, at = BASE, data.astype(np.uint64) + np.uint64(1), None, 0
    size, left = 1, width
    n = data.shape[-1] - width + 1
    while True:
        if left & 1:
            piece = have[..., at : at + n]
            out = piece.copy() if out is None else out * power + piece
            at += size
        left >>= 1
        if not left:
            return out
        have = have[..., : have.shape[-1] - size] * power + have[..., size:]
        power = power * power
        size *= 2


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram hash) of a text's bytes; every window is in one row."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64)
    grams = rolled(data, gram)
    order = grams ^ grams >> np.uint64(32)
    order *= MIX
    order ^= order >> np.uint64(29)
    order = order & ~PLACE | np.arange(len(order), dtype=np.uint64)
    w = length - gram + 1
    rows = -(-len(order) // w)
    square = np.full((rows, w), np.iinfo(np.uint64).max, np.uint64)
    square.ravel()[: len(order)] = order
    ahead = np.minimum.accumulate(square, 1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    n = len(data) - length + 1
    low = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    at = (low[first] & PLACE).astype(np.int64)
    return at, first, np.r_[first[1:], n] - 1, grams[at]


def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchor suffixes of texts: lead, gram, context hashes, place, first and last window."""
    shift = np.arange(56, -8, -8, dtype=np.uint64)
    for batch in batches:
        out: list[list[np.ndarray]] = []

        def frame(out: list) -> pd.DataFrame:
            names = ("doc_id", "hash", "lead", "gram", "context", "at", "first", "last")
            kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
            return pd.DataFrame({n: np.concatenate(c).astype(k, copy=False) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

        rows = 0
        for doc, mark, text in zip(batch["doc_id"].to_numpy(), batch["hash"].to_numpy(), batch["text"], strict=True):
            raw = (text or "").encode()
            whole = np.frombuffer(raw, np.uint8)
            for start in range(0, max(len(raw) - LENGTH + 1, 0), PART):
                data = whole[start : start + PART + LENGTH - 1]
                at, first, last, gram = anchors(data)
                lead = (data[at[:, None] + np.arange(8)].astype(np.uint64) << shift).sum(1, dtype=np.uint64)
                digest, at, first, last = xxhash.xxh64_intdigest, at + start, first + start, last + start
                context = [digest(raw[p : q + LENGTH], a - p) for a, p, q in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
                n = len(at)
                out.append([np.full(n, doc), np.full(n, mark), lead.view(np.int64), gram.view(np.int64), np.array(context, np.uint64).view(np.int64), at, first, last])
                rows += n
            if rows > 50_000:
                yield frame(out)
                out, rows = [], 0
        if out:
            yield frame(out)


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by columns: three-way partitions around a pivot, going on by the next column among equals."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        part = order[a:b]
        if b - a < 2048:
            order[a:b] = part[np.lexsort([c[part] for c in reversed(columns[depth:])])]
            continue
        key = columns[depth][part]
        pivot = np.partition(key[:: max(1, len(key) // 255)], len(key[:: max(1, len(key) // 255)]) // 2)[len(key[:: max(1, len(key) // 255)]) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[a:b] = np.r_[part[less], part[same], part[more]]
        x, y = a + int(less.sum()), b - int(more.sum())
        todo += [(a, x, depth), (y, b, depth)]
        if depth + 1 < len(columns):
            todo.append((x, y, depth + 1))
    return order


SPAN = "doc_id long, hash long, start int, end int"
KIND = "kind string, doc_id long, hash long, lead long, gram long, context long, at int, first int, last int"


def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A bucket's suffixes that repeat whole ("full"), must be compared ("some"), or touch its bounds ("edge", how many, whether its group has others)."""
    frames = list(batches)
    if not sum(map(len, frames)):
        return
    bucket = pd.concat(frames, ignore_index=True)
    lead, gram, context = (bucket[c].to_numpy() for c in ("lead", "gram", "context"))
    order = multikey_quicksort([lead, gram, context])
    lead, gram, context = lead[order], gram[order], context[order]
    group = np.r_[True, (lead[1:] != lead[:-1]) | (gram[1:] != gram[:-1])]
    own = group | np.r_[True, context[1:] != context[:-1]]
    g, c = np.cumsum(group) - 1, np.cumsum(own) - 1
    several = np.bincount(g[own])[g] > 1
    twice = np.bincount(c)[c] > 1
    edge = (c == 0) | (c == c[-1])
    kinds = [("full", twice), ("some", several & own & ~edge)]
    for n, counted in ((1, ~twice), (2, twice)):
        for s, seen in (("", ~several), ("s", several)):
            kinds.append((f"edge{n}{s}", edge & own & counted & seen))
    for kind, rows in kinds:
        found = bucket.take(order[rows])
        for k in range(0, len(found), 50_000):
            yield found.iloc[k : k + 50_000].assign(kind=kind)


def _across(edges: DataFrame) -> DataFrame:
    """Verdicts on the contexts at buckets' bounds: one row for each context and bound, so a small table."""
    group, same = Window.partitionBy("lead", "gram"), Window.partitionBy("lead", "gram", "context")
    me = F.struct("doc_id", "hash", "at")
    known = (
        edges.withColumn("n", F.sum(F.substring("kind", 5, 1).cast("int")).over(same))
        .withColumn("several", (F.max(F.col("kind").endswith("s")).over(group)) | (F.min("context").over(group) != F.max("context").over(group)))
        .withColumn("is_head", F.min(me).over(same) == me)
    )
    # A context of several rows in its bucket is "full" there already.
    kinds = F.array(F.when((F.col("n") > 1) & F.col("kind").startswith("edge1"), F.lit("full")), F.when(F.col("several") & F.col("is_head"), F.lit("some")))
    judged = known.withColumn("kind", F.explode(F.array_compact(kinds)))
    return judged.select("kind", "doc_id", "hash", "lead", "gram", "context", "at", "first", "last")


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of compared suffixes' windows, a row for each block of window offsets."""
    for batch in batches:
        out = []
        for doc, mark, text, wanted in zip(batch["doc_id"], batch["hash"], batch["text"], batch["wanted"], strict=True):
            raw = text.encode()
            for w in wanted:
                at, first, last = w["at"], w["first"], w["last"]
                for block in range((at - last) // WIDTH, (at - first) // WIDTH + 1):
                    # Windows that begin d bytes before the anchor, d from low to high.
                    low, high = max(block * WIDTH, at - last), min(block * WIDTH + WIDTH - 1, at - first)
                    a, b = at - block * WIDTH, at - block * WIDTH - WIDTH + 1 + LENGTH  # bytes all the block's windows share
                    key = xxhash.xxh64_intdigest(raw[a:b], block)
                    out.append((key - (1 << 64) * (key >> 63), doc, mark, at - high, at - low, block, raw[at - high : at - low + LENGTH], at))
            if len(out) >= 5_000:
                yield pd.DataFrame(out, columns=["key", "doc_id", "hash", "first", "last", "block", "bytes", "at"])
                out = []
        yield pd.DataFrame(out, columns=["key", "doc_id", "hash", "first", "last", "block", "bytes", "at"])


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of windows that occur twice under a key; rows come sorted by key."""

    def repeats(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["key"].to_numpy()
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        many = np.bincount(group)[group] > 1
        rows, group = rows[many], group[many].astype(np.uint64)
        if not len(rows):
            return pd.DataFrame({"doc_id": [], "hash": [], "start": [], "end": []})
        first, last, at, block = (rows[c].to_numpy() for c in ("first", "last", "at", "block"))
        low = at - last - block * WIDTH  # column of the row's last window
        square = np.zeros((len(rows), WIDTH - 1 + LENGTH), np.uint8)
        # Bytes line up so that column c of the hashes is the window that begins WIDTH - 1 - c further from the anchor.
        for i, (raw, lo) in enumerate(zip(rows["bytes"], low, strict=True)):
            end = WIDTH - 1 + LENGTH - lo
            square[i, end - len(raw) : end] = np.frombuffer(raw, np.uint8)
        hashes = rolled(square, LENGTH)
        column = np.arange(WIDTH)
        there = (column >= WIDTH - 1 - (low + last - first)[:, None]) & (column <= WIDTH - 1 - low[:, None])
        place = (group[:, None] * np.uint64(WIDTH) + column.astype(np.uint64))[there]
        mixed = hashes[there] ^ place * MIX
        order = np.argsort(mixed, kind="stable")
        mixed, place = mixed[order], place[order]
        equal = (mixed[1:] == mixed[:-1]) & (place[1:] == place[:-1])
        hit = np.zeros(len(mixed), bool)
        hit[order[1:][equal]] = True
        hit[order[:-1][equal]] = True
        marked = np.zeros((len(rows), WIDTH + 2), np.int8)
        marked[:, 1:-1][there] = hit
        step = np.diff(marked, axis=1)
        r, begin = np.nonzero(step == 1)
        _, stop = np.nonzero(step == -1)
        origin = (at - block * WIDTH - WIDTH + 1)[r]
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[r], "hash": rows["hash"].to_numpy()[r], "start": origin + begin, "end": origin + stop - 1 + LENGTH})

    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield repeats(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
            held = []
        elif held and held[-1]["key"].iloc[-1] != key[-1]:
            yield repeats(pd.concat(held, ignore_index=True))
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield repeats(pd.concat(held, ignore_index=True))


def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of each block: its key, distance to the anchor, a 128-bit hash, and where it is."""
    digest = xxhash.xxh128_digest
    for batch in batches:
        for k in range(0, len(batch), 2_000):
            out = []
            for r in batch.iloc[k : k + 2_000].itertuples():
                for start in range(r.first, r.last + 1):
                    out.append((r.key, r.at - start, digest(r.bytes[start - r.first : start - r.first + LENGTH]), r.doc_id, r.hash, start))
            yield pd.DataFrame(out, columns=["key", "ahead", "window", "doc_id", "hash", "start"])


def _counted(rows: DataFrame) -> DataFrame:
    """``compared`` for keys of any size: windows are counted with partial sums, and those of repeated ones kept."""
    every = rows.mapInPandas(windows, "key long, ahead int, window binary, doc_id long, hash long, start int")
    by = ["key", "ahead", "window"]
    twice = every.groupBy(*by).count().where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in by])
    same = (F.col("key") == F.col("_key")) & (F.col("ahead") == F.col("_ahead")) & (F.col("window") == F.col("_window"))
    return every.join(twice, same, "left_semi").select("doc_id", "hash", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(doc_id, hash, spans): byte spans that repeated windows cover, not united; ``docs`` has doc_id, hash, text."""
    spark = docs.sparkSession
    found = written(docs.mapInPandas(suffixes, KIND.replace("kind string, ", "")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // BUCKET))
    ranged = found.repartitionByRange(n, "lead", "gram", "context", "doc_id", "at")
    judged = written(ranged.mapInPandas(neighbours, KIND))
    dropped(found)
    every = written(judged.where("kind not like 'edge%'").unionByName(_across(judged.where("kind like 'edge%'"))))
    wanted = every.where("kind = 'some'").groupBy("doc_id", "hash").agg(F.collect_set(F.struct("at", "first", "last")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"), "wanted")
    # Of rows that repeat a document whole, "full" says all; one stands for them here.
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash"))).select("doc_id", "hash", "text", "wanted")
    rows = texts.mapInPandas(blocks, "key long, doc_id long, hash long, first int, last int, block int, bytes binary, at int")
    rows = written(rows)
    hot = written(rows.groupBy("key").count().where(F.col("count") > together).select(F.col("key").alias("hot")))
    cold = rows
    if hot.count():
        hot = small(hot, BROADCAST_KEYS)
        cold = rows.join(hot, F.col("key") == F.col("hot"), "left_anti")
    met = cold.repartition("key").sortWithinPartitions("key")
    partly = met.mapInPandas(compared, SPAN)
    if cold is not rows:
        partly = partly.unionByName(_counted(rows.join(hot, F.col("key") == F.col("hot")).drop("hot")))
    partly = written(partly)
    dropped(rows)
    full = every.where("kind = 'full'").select("doc_id", "hash", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    return full.unionByName(partly).groupBy("doc_id", "hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def united(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """doc_id, text, spans: every document with its repeated spans, not united."""
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(NAMELESS)).alias("_id"), F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(texts.select(F.col("_id").alias("doc_id"), "hash", "text"), together).select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"), "spans")
    return texts.join(spans, (F.col("_id") == F.col("_doc")) & (F.col("hash") == F.col("_hash")), "left").select("doc_id", "text", "spans")


def _digests(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, some in zip(texts, spans, strict=True):
        raw, gone = text.encode(), united(some) if some is not None else []
        kept, at = hashlib.sha256(), 0
        for a, b in gone:
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        out.append((len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digested(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    digests = F.pandas_udf(_digests, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return removed(docs, together).select("doc_id", digests("text", "spans").alias("d")).select("doc_id", "d.*")
