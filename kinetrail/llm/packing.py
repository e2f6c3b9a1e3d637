"""Best-fit packing of tokenized documents by linear grouping.

A document's ids end in id 0; longer ones than a sequence are cut into full pieces behind a
shorter first one. Lengths are whole numbers up to ``capacity``, so the plan is made on their
histogram, whose size depends on the capacity alone, for any number of documents:

1. Large lengths (over a quarter of the capacity, at most three to a sequence) fall into groups
   of equal cardinality and are rounded up to each group's largest.
2. Configurations of these few sizes are optimised: the linear programme over all of them is
   solved by the revised simplex method, rounded down, and the rest is filled greedily.
   Those that the rounded sizes fill to under ``FULL`` are dissolved again.
3. Actual lengths take the places of their group, longest first.
4. All other lengths, dissolved ones among them, go, longest first, to the sequences with the least room that holds them.

A piece's place follows from its rank among the pieces of its length: ranks are counted within
(length, hash bucket) and continue over the buckets, so that a length with most of the rows is
many tasks. Null and empty texts are one piece of one id, and a null doc_id stays null. Repeated rows are packed one by one,
by (doc_id, piece, crc) and a row number within their bucket. An empty table packs nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import written

CAPACITY = 2048
GROUPS = (20, 40)
FULL = (0.99, 0.999)
BUCKETS = 256
#: Pre-token pattern of byte-level BPE and its one special token: fixed values of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
SPACES = re.compile(r"\s+")
LONG_SPACES = 100_000


def encoder(path: str):
    """text -> ids as little-endian 32-bit words, without special tokens at the ends.

    ``path`` is a byte-level BPE file of the tokenizers library. Its ids are ranks of merges, so
    that tiktoken's faster loop gives the same ids; tests hold the two against each other. Its
    pattern matcher gives up on about a million white characters in a row, so that texts with
    a long run of them go through the tokenizers library.
    """
    with open(path) as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # Byte-level files write a byte as the character of that code if it prints, else from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = vocabulary.pop(SPECIAL, None) or len(vocabulary)
    ranks = {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items()}
    slow = lru_cache(lambda: Tokenizer.from_file(path))
    bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: special})

    def encode(text: str) -> bytes:
        if len(text) > LONG_SPACES and any(len(m[0]) > LONG_SPACES for m in SPACES.finditer(text)):
            return np.array(slow().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return bpe.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    return encode


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. path: the vocabulary file, which all executors have."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            out = []
            for doc, unnamed, text in zip(batch["doc_id"], batch["unnamed"], batch["text"], strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    out.append((doc, unnamed, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            yield pd.DataFrame(out, columns=["doc_id", "unnamed", "piece", "start", "length", "ids_crc32"])

    # Without nulls, ids stay whole numbers in pandas.
    named = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), "text")
    cut = named.mapInPandas(pieces, "doc_id long, unnamed boolean, piece int, start long, length long, ids_crc32 long")
    return cut.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).drop("unnamed")


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All multisets of the sizes that fit, as counts."""
    picks, out = [((), capacity)], []
    while picks:
        picks = [((*p, i), room - sizes[i]) for p, room in picks for i in range(p[-1] if p else 0, len(sizes)) if sizes[i] <= room]
        out += [np.bincount(p, minlength=len(sizes)).astype(np.int32) for p, _ in picks]
    return np.array(out)


def few_sizes(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often, covering ``counts`` with about the fewest sequences."""
    configs = configurations(sizes, capacity)
    m = len(sizes)
    singles = [next(i for i, c in enumerate(configs) if c.sum() == c[k] == max(x[k] for x in configs if x.sum() == x[k])) for k in range(m)]
    basis = list(singles)
    for _ in range(50 * m):
        b = configs[basis].T.astype(float)
        price = np.linalg.solve(b.T, np.ones(m))
        value = configs @ price
        best = int(value.argmax())
        if value[best] <= 1 + 1e-9:
            break
        at, direction = np.linalg.solve(b, np.array(counts, float)), np.linalg.solve(b, configs[best].astype(float))
        ratio = np.where(direction > 1e-12, at / np.where(direction > 1e-12, direction, 1), np.inf)
        basis[int(ratio.argmin())] = best
    often = np.floor(np.linalg.solve(configs[basis].T.astype(float), np.array(counts, float)) + 1e-9).astype(int)
    out, left = [], np.array(counts)
    for config, n in sorted(zip(map(tuple, configs[basis]), often.tolist(), strict=True), reverse=True):
        n = min([n, *(int(have) // c for have, c in zip(left, config, strict=True) if c)])
        if n > 0:
            out.append((config, n))
            left = left - n * np.array(config)
    weight = configs @ np.array(sizes)
    while left.sum():
        best = int(np.where((configs <= left).all(1), weight, -1).argmax())
        n = min(int(have) // c for have, c in zip(left, configs[best], strict=True) if c)
        out.append((tuple(configs[best]), n))
        left = left - n * configs[best]
    return out


def grouped(histogram: dict[int, int], capacity: int, groups: int, full: float) -> list[list]:
    """Linear grouping: sequences as [how many, room, [(length, copies), ...]]."""
    limit = capacity // 4
    rest = Counter({k: n for k, n in histogram.items() if k <= limit})
    bins: list[list] = []  # [how many sequences, room, [(length, copies), ...]]
    if n := histogram.get(capacity):
        bins.append([n, 0, [(capacity, 1)]])
    large = [k for k in sorted(histogram) if limit < k < capacity]
    if large:
        total = sum(histogram[k] for k in large)
        per, members, cut = -(-total // groups), [], 0
        for k in large:  # equal cardinality, split within a length where need be
            n = histogram[k]
            while n:
                part = min(n, per - cut)
                if not cut:
                    members.append([])
                members[-1].append([k, part])
                cut, n = (cut + part) % per, n - part
        top: dict[int, list] = {}
        for g in members:  # groups that round to the same size are one
            top.setdefault(g[-1][0], []).extend(g)
        sizes = sorted(top)
        stock = [sorted(top[k]) for k in sizes]
        for config, often in few_sizes(sizes, [sum(n for _, n in g) for g in stock], capacity):
            if sum(n * k for n, k in zip(config, sizes, strict=True)) < full * capacity:
                continue
            places = [_longest(stock[g], often) for g, n in enumerate(config) for _ in range(n)]
            for lengths, n in _side_by_side(places):
                bins.append([n, capacity - sum(lengths), [(k, 1) for k in lengths]])
        for g in stock:
            for k, n in g:
                rest[k] += n
    return _best_fit(bins, rest, capacity)


def _longest(stock: list[list[int]], n: int) -> list[list[int]]:
    """Takes the n longest off a stock of [length, how many] in rising order."""
    out = []
    while n:
        k, have = stock[-1]
        part = min(n, have)
        out.append([k, part])
        n -= part
        if part == have:
            stock.pop()
        else:
            stock[-1][1] -= part
    return out


def _side_by_side(places: list[list[list[int]]]) -> Iterator[tuple[list[int], int]]:
    """Runs of sequences that have the same length at each place."""
    while places[0]:
        n = min(p[0][1] for p in places)
        yield [p[0][0] for p in places], n
        for p in places:
            p[0][1] -= n
            if not p[0][1]:
                p.pop(0)


def _best_fit(bins: list[list], histogram: dict[int, int], capacity: int) -> list[list]:
    """``bins`` [how many, room, [(length, copies), ...]] with all of ``histogram`` put in, longest first, where it fits best."""
    by_room: dict[int, list[list]] = {}
    for b in bins:
        by_room.setdefault(b[1], []).append(b)
    for k in sorted(histogram, reverse=True):
        left = histogram[k]
        rooms = sorted(r for r in by_room if r >= k)
        while left:
            while rooms and not by_room.get(rooms[0]):
                rooms.pop(0)
            if rooms:
                b = by_room[rooms[0]].pop()
                side = min(rooms[0] // k, left)
            else:
                side = min(capacity // k, left)
                b = [left // side, capacity, []]
            n = min(b[0], left // side)
            if n < b[0]:
                by_room.setdefault(b[1], []).append([b[0] - n, b[1], list(b[2])])
            room = b[1] - side * k
            by_room.setdefault(room, []).append([n, room, [*b[2], (k, side)]])
            left -= n * side
    return [b for same in by_room.values() for b in same]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, how many ranks, first sequence, offset, copies side by side).

    A few numbers of groups and fillings are tried; the plan with the fewest sequences stays.
    """
    histogram = {k: n for k, n in histogram.items() if n}
    tried = (grouped(histogram, capacity, g, full) for g in GROUPS for full in FULL)
    bins = min(tried, key=lambda x: sum(b[0] for b in x))
    out, rank, sequence = [], Counter(), 0
    for b in bins:
        offset = 0
        for k, side in b[2]:
            out.append((k, rank[k], b[0] * side, sequence, offset, side))
            rank[k] += b[0] * side
            offset += k * side
        sequence += b[0]
    return sorted(out)


def placed(ranked: DataFrame, rows: list[tuple]) -> DataFrame:
    """``ranked`` (length, rank, ...) with sequence_id and offset; ``rows`` is the plan, bounded by the capacity."""
    table = np.array(rows, np.int64).reshape(-1, 6)
    lengths, firsts = table[:, 0], table[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = np.searchsorted(lengths, np.arange(lengths.max(initial=0) + 2))
        key = lengths.astype(np.float64) * 2.0**42 + firsts  # exact: ranks stay below 2^42
        for batch in batches:
            k, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(key, k.astype(np.float64) * 2.0**42 + rank, side="right") - 1
            assert len(at) == 0 or (at >= starts[k]).all()
            row, r = table[at], rank - firsts[at]
            yield batch.assign(sequence_id=row[:, 3] + r // row[:, 5], offset=row[:, 4] + r % row[:, 5] * k).drop(columns="rank")

    named = ranked.withColumns({"doc_id": F.coalesce("doc_id", F.lit(0)), "unnamed": F.col("doc_id").isNull()})
    out = named.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, unnamed boolean, sequence_id long, offset long")
    return out.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).drop("unnamed")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    pieces = written(tokenized(docs, path, capacity))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    counts = written(pieces.groupBy("length", bucket.alias("bucket")).agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_length"), "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = written(base)  # at most capacity * buckets rows of 24 bytes
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("_bucket", bucket).withColumn("_own", F.row_number().over(own) - 1)
    met = numbered.join(F.broadcast(base), (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("bucket")))
    ranked = met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("_own")).alias("rank"))
    return placed(ranked, plan(histogram, capacity))
