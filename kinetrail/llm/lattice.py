"""Language-model scores: the marginal probability of a text over all segmentations into known subwords.

The pieces are those of an existing tokenizer's vocabulary. Its scores are ranks of frequency, so a piece starts with
the weight 1 / (1 + rank); bytes and the end of a text start with that of the last rank. A text is its words and an end.
A word, behind the mark of a word's start, is a lattice: an edge for each piece that stands at a place, and where not even a
single character is a piece, an edge over its UTF-8 bytes. A word's probability is the sum over all paths, by the
forward recursion in log space, a text's the product over its words and of the end's, so that probabilities of texts sum to 1 at most.

Weights are re-estimated ``ROUNDS`` times by expectation-maximisation over all training words: forward and backward sums give
each piece's expected count, ``PRIOR`` pieces dealt by the starting weights are added, and the end counts once a text. As lattices do not
cross words, every distinct word of the corpus is worked on once, weighted by its count, wherever it lies; what meets on the driver is a number a piece.

A text's words are looked up in a table of the ``HOT`` most frequent short words, which every task holds (at most HOT words of
``HOT_BYTES``); the others are joined with the table of all words, one row a text and word. Nothing is cut, dropped or sampled.

Null texts are empty: their only token is the end. A null doc_id is trained on. Repeated rows are scored each and counted
each. Bytes that are not UTF-8 count as U+FFFD. An empty table gives an empty result. With no training text at all the starting weights score.
A literal U+2581 in a word matches like a word's start. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

HOT = 131_072
HOT_BYTES = 256
ROUNDS = 3
PRIOR = 1000.0
#: Distinct words a task holds before it passes counts on; words and bytes of words in one step of the recursion.
HELD = 200_000
STEP_WORDS = 16_384
STEP_BYTES = 1_000_000
#: Words longer than this are walked one at a time.
LONG = 96
START = 0x2581
CODE = 21


def vocabulary(path: str) -> dict:
    """Pieces of a sentencepiece model as a trie in an exact hash table, their starting weights, ids of bytes and of the end."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    weight = np.zeros(n)
    weight[usable] = 1 / (1 - np.minimum([sp.get_score(i) for i in usable], 0))
    rare = [i for i in range(n) if sp.is_byte(i)]
    weight[[*rare, sp.eos_id()]] = 1 / n
    children: dict[int, int] = {}
    piece = [-1]
    for i in usable:
        node = 0
        for c in sp.id_to_piece(i):
            key = node << CODE | ord(c)
            if key not in children:
                children[key] = len(piece)
                piece.append(-1)
            node = children[key]
        piece[node] = i
    bits = max(len(children) * 8, 16).bit_length()
    slots = np.full(1 << bits, -1, np.int64)
    nodes = np.zeros(1 << bits, np.int32)
    for key, node in children.items():
        at = int(_slot(np.array([key]), bits)[0])
        while slots[at] >= 0:
            at = (at + 1) & ((1 << bits) - 1)
        slots[at], nodes[at] = key, node
    return {"slots": slots, "nodes": nodes, "bits": bits, "piece": np.array(piece, np.int32), "weight": weight / weight.sum(), "bytes": np.array(rare), "end": sp.eos_id()}


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _child(v: dict, node: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Trie nodes below ``node`` by ``code``, -1 where there is none."""
    keys = node.astype(np.int64) << CODE | code
    at = _slot(keys, v["bits"])
    out = np.full(len(keys), -1, np.int32)
    todo = np.arange(len(keys))
    while len(todo):
        seen = v["slots"][at[todo]]
        hit = seen == keys[todo]
        out[todo[hit]] = v["nodes"][at[todo[hit]]]
        todo = todo[~hit & (seen >= 0)]
        at[todo] = (at[todo] + 1) & ((1 << v["bits"]) - 1)
    return out


def _byte_ids(v: dict, code: int) -> np.ndarray:
    return v["bytes"][list(chr(code).encode("utf-8", "replace"))]


class Lattices:
    """The lattices of many words: parallel arrays of edges, and sums over their paths."""

    def __init__(self, v: dict, words: list[bytes]):
        codes = np.frombuffer(b"\n".join([b"", *words]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.flatnonzero(codes == 10)
        codes[first] = START
        size = np.diff([*first, len(codes)])
        word = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(codes)) - np.repeat(first, size)
        left = np.repeat(size, size) - at
        self.v, self.size, self.n = v, size, len(words)
        rows, begins, lengths, ids = [], [], [], []
        alive, node = np.arange(len(codes)), np.zeros(len(codes), np.int32)
        odd = np.zeros(0, np.int64)
        reach = 0
        while len(alive):
            node = _child(v, node, codes[alive + reach])
            reach += 1
            piece = np.where(node >= 0, v["piece"][node], -1)
            if reach == 1:
                odd = alive[piece < 0]  # not even this character is a piece
            found = piece >= 0
            rows.append(word[alive[found]])
            begins.append(at[alive[found]])
            lengths.append(np.full(found.sum(), reach))
            ids.append(piece[found])
            on = (node >= 0) & (left[alive] > reach)
            alive, node = alive[on], node[on]
        self.odd = codes[odd]  # their edges come last
        self.row = np.concatenate([*rows, word[odd]])
        self.begin = np.concatenate([*begins, at[odd]])
        self.end = np.concatenate([*begins, at[odd]]) + np.concatenate([*lengths, np.ones(len(odd), np.int64)])
        self.id = np.concatenate([*ids, np.full(len(odd), -1, np.int64)])

    def weights(self, logp: np.ndarray) -> np.ndarray:
        out = logp[self.id]
        if len(self.odd):
            kinds, which = np.unique(self.odd, return_inverse=True)
            out[len(out) - len(self.odd) :] = np.array([logp[_byte_ids(self.v, int(c))].sum() for c in kinds])[which]
        return out

    def _sums(self, weight: np.ndarray, source: np.ndarray, target: np.ndarray, at: np.ndarray, order: range) -> None:
        """Fills ``at`` [place, word] in the order of places from what edges bring from their other end."""
        by = np.argsort(target.astype(np.uint16), kind="stable")  # places are few: a radix sort
        bounds = np.searchsorted(target[by], np.arange(len(at) + 1))
        for i in order:
            e = by[bounds[i] : bounds[i + 1]]
            if len(e):
                row = self.row[e]
                came = at[source[e], row] + weight[e]
                most = np.full(self.n, -np.inf)
                np.maximum.at(most, row, came)
                got = np.bincount(row, np.exp(came - most[row]), self.n)
                has = got > 0
                at[i, has] = most[has] + np.log(got[has])

    def forward(self, weight: np.ndarray) -> np.ndarray:
        at = np.full((int(self.size.max(initial=0)) + 1, self.n), -np.inf)
        at[0] = 0
        self._sums(weight, self.begin, self.end, at, range(1, len(at)))
        return at

    def backward(self, weight: np.ndarray) -> np.ndarray:
        at = np.full((int(self.size.max(initial=0)) + 1, self.n), -np.inf)
        at[self.size, np.arange(self.n)] = 0
        self._sums(weight, self.end, self.begin, at, range(len(at) - 2, -1, -1))
        return at

    def logs(self, logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability."""
        return self.forward(self.weights(logp))[self.size, np.arange(self.n)]

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece, words weighted by ``counts``."""
        weight = self.weights(logp)
        a, b = self.forward(weight), self.backward(weight)
        mass = np.exp(a[self.begin, self.row] + weight + b[self.end, self.row] - a[self.size[self.row], self.row]) * counts[self.row]
        known = len(mass) - len(self.odd)
        out = np.bincount(self.id[:known], mass[:known], len(logp))
        kinds, which = np.unique(self.odd, return_inverse=True)
        for c, m in zip(kinds.tolist(), np.bincount(which, mass[known:], len(kinds)), strict=True):
            np.add.at(out, _byte_ids(self.v, c), m)
        return out


def _edges(v: dict, codes: np.ndarray, at: int, lower: int, upper: int) -> tuple[np.ndarray, ...]:
    """(begin, end, id) of the pieces that start in codes[lower:upper], for a part of one long word; ``at`` is the part's place."""
    begins, ends, ids = [], [], []
    alive, node, reach = np.arange(lower, upper), np.zeros(upper - lower, np.int32), 0
    while len(alive):
        node = _child(v, node, codes[alive + reach])
        reach += 1
        piece = np.where(node >= 0, v["piece"][node], -1)
        if reach == 1:
            piece = np.where(piece < 0, -2, piece)
        found = piece != -1
        begins.append(alive[found] + at)
        ends.append(alive[found] + at + reach)
        ids.append(piece[found])
        on = (node >= 0) & (alive + reach < len(codes))
        alive, node = alive[on], node[on]
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(ids)


def _walked(v: dict, word: bytes, logp: np.ndarray, count: float | None) -> tuple[float, np.ndarray | None]:
    """One long word: (log probability, expected counts if ``count``), in steps over its characters, memory in proportion to them."""
    codes = np.frombuffer(("▁" + word.decode("utf-8", "replace")).encode("utf-32-le"), np.uint32).astype(np.int64)
    n, step = len(codes), 1 << 16
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0], backward[n] = 0.0, 0.0

    def parts(order):
        for lower in order:
            begin, end, ids = _edges(v, codes, 0, lower, min(lower + step, n))
            weight = logp[ids]
            odd = np.flatnonzero(ids == -2)
            weight[odd] = [logp[_byte_ids(v, int(c))].sum() for c in codes[begin[odd]]]
            yield begin, end, ids, weight

    def meet(to: list, of: int, value: float) -> None:
        a = to[of]
        high, low = (a, value) if a > value else (value, a)
        to[of] = high if low == -np.inf else high + np.log1p(np.exp(low - high))

    sums = forward.tolist()
    for begin, end, _, weight in parts(range(0, n, step)):
        for k in np.argsort(begin, kind="stable").tolist():
            meet(sums, int(end[k]), sums[int(begin[k])] + float(weight[k]))
    total = sums[n]
    if count is None:
        return total, None
    forward = np.array(sums)
    sums = backward.tolist()
    for begin, end, _, weight in parts(range((n - 1) // step * step, -1, -step)):
        for k in np.argsort(-begin, kind="stable").tolist():
            meet(sums, int(begin[k]), sums[int(end[k])] + float(weight[k]))
    backward = np.array(sums)
    out = np.zeros(len(logp))
    for begin, end, ids, weight in parts(range(0, n, step)):
        mass = np.exp(forward[begin] + weight + backward[end] - total) * count
        odd = ids == -2
        out += np.bincount(ids[~odd], mass[~odd], len(logp))
        for b, m in zip(begin[odd].tolist(), mass[odd], strict=True):
            np.add.at(out, _byte_ids(v, int(codes[b])), m)
    return total, out


def log_probabilities(v: dict, words: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability over all its segmentations."""
    out = np.zeros(len(words))
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    if short:
        out[short] = Lattices(v, [words[k] for k in short]).logs(logp)
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k], _ = _walked(v, w, logp, None)
    return out


def expected_counts(v: dict, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    out = Lattices(v, [words[k] for k in short]).expected(logp, counts[short]) if short else np.zeros(len(logp))
    for k, w in enumerate(words):
        if len(w) > LONG:
            out = out + _walked(v, w, logp, float(counts[k]))[1]
    return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, counts), so many at once that the recursion's fixed costs do not matter and its memory stays bounded."""
    words, counts, held = [], [], 0
    for batch in batches:
        for w, c in zip(batch["word"].to_pylist(), batch["c"].to_pylist(), strict=True):
            if words and (len(words) >= STEP_WORDS or held + len(w) > STEP_BYTES):
                yield words, np.array(counts, np.float64)
                words, counts, held = [], [], 0
            words.append(w)
            counts.append(c)
            held += len(w)
    if words:
        yield words, np.array(counts, np.float64)


def _texts(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word binary, n (occurrences), c (occurrences in training texts); the end of a text is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, others = Counter(), Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, tally in ((1, trained), (0, others)):
                n = np.fromiter(tally.values(), np.int64, len(tally))
                yield pa.record_batch({"word": pa.array(tally.keys(), pa.binary()), "n": n, "c": n * kind})
                tally.clear()

        for batch in batches:
            for held, text in zip(batch["held_out"].to_pylist(), batch["text"].to_pylist(), strict=True):
                tally = others if held else trained
                tally.update(text.lower().split())
                tally[b""] += 1
                if len(trained) + len(others) > HELD:
                    yield from rows()
        yield from rows()

    return texts.select("held_out", "text").mapInArrow(count, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit(counts: DataFrame, v: dict, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Natural log weights of all pieces (0 to len - 1), fitted to the words with c > 0."""
    spark = counts.sparkSession
    ends = counts.where("word = X''").agg(F.sum("c")).first()[0] or 0
    trained = counts.where("c > 0 and word != X''").select("word", "c")
    shared = spark.sparkContext.broadcast(v)
    p = v["weight"]
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            now = spark.sparkContext.broadcast(np.log(p))

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            mass = np.zeros(len(now.value))
            for words, n in _steps(batches):
                mass += expected_counts(shared.value, words, n, now.value)
            has = np.flatnonzero(mass)
            yield pa.record_batch({"piece": has.astype(np.int32), "mass": mass[has]})

        mass = np.zeros(len(p))
        for r in trained.mapInArrow(expect, "piece int, mass double").groupBy("piece").agg(F.sum("mass").alias("mass")).collect():  # a row a piece
            mass[r.piece] = r.mass
        mass[v["end"]] = ends
        p = (mass + prior * v["weight"]) / (mass.sum() + prior)
    with np.errstate(divide="ignore"):
        return np.log(p)


def word_scores(counts: DataFrame, v: dict, logp: np.ndarray) -> DataFrame:
    """word, n, c and score, the word's log10 probability (the end's for the empty word)."""
    shared, weights = (counts.sparkSession.sparkContext.broadcast(x) for x in (v, logp))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n in _steps(batches):
            logs = log_probabilities(shared.value, words, weights.value)
            logs[[k for k, w in enumerate(words) if not w]] = weights.value[shared.value["end"]]
            yield pa.record_batch({"word": pa.array(words, pa.binary()), "c": n.astype(np.int64), "score": logs / np.log(10)})

    return counts.select("word", "c").mapInArrow(score, "word binary, c long, score double")


def frequent(counts: DataFrame, many: int = HOT) -> DataFrame:
    """At most ``many`` short words, the most frequent ones, by a bound of their count from a histogram of some hundred bins."""
    short = counts.where(F.length("word") <= HOT_BYTES)
    level = F.floor(8 * F.log2("n")).cast("int")
    total, least = 0, None
    for r in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > many:
            break
        least = r.level
    return short.where(level >= least).select("word") if least is not None else short.where("false").select("word")


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document; learns from those not held out."""
    spark = docs.sparkSession
    texts = _texts(docs)
    counts = written(word_counts(texts))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    v = vocabulary(path)
    words = written(word_scores(counts, v, fit(counts, v)))
    top = words.join(frequent(counts), "word").toPandas()
    whole = float(np.log10(totals.n + totals.v + 1))
    c = top["c"].to_numpy(np.int64)
    values = zip((c > 0).tolist(), (np.log10(c + 1) - whole).tolist(), top["score"].tolist(), strict=True)
    hot = spark.sparkContext.broadcast(dict(zip(map(bytes, top["word"]), values, strict=True)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        for batch in batches:
            sums: list[list] = [[], [], [], []]
            bounds, rest, often = [0], [], []
            for text in batch["text"].to_pylist():
                found = Counter(text.lower().split())
                found[b""] += 1
                tokens = known = 0
                base = model = 0.0
                for w, n in found.items():
                    tokens += n
                    if got := table.get(w):
                        known += n * got[0]
                        base += n * got[1]
                        model += n * got[2]
                    else:
                        rest.append(w)
                        often.append(n)
                for to, x in zip(sums, (tokens, known, base, model), strict=True):
                    to.append(x)
                bounds.append(len(rest))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(often, pa.int64())], ["word", "n"])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["doc_id"], batch["held_out"], *(pa.array(s, k) for s, k in zip(sums, kinds, strict=True)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)],
                ["id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"],
            )

    asked = texts.select(F.monotonically_increasing_id().alias("id"), "doc_id", "held_out", "text")
    kinds = f"id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<word: binary, n: bigint>>"
    met = written(asked.mapInArrow(ask, kinds))  # once written, ids stay
    rest = met.select("id", F.explode("rest").alias("r")).select("id", "r.word", "r.n")
    base = F.log10(F.col("c") + 1) - F.lit(whole)
    more = rest.join(words, "word").groupBy(F.col("id").alias("_id")).agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * base).alias("b"), F.sum(F.col("n") * F.col("score")).alias("s"))
    zero = F.lit(0.0)
    return met.join(more, F.col("id") == F.col("_id"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(int(totals.n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
