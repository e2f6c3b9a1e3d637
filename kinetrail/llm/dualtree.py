"""Hard negatives by dual-tree search over integer inner products.

Rows are dealt to shards by a tree of hyperplanes, fitted to a bounded sample (``SAMPLE`` rows of each length of vectors at most, the first by hash);
equal projections, as of very many copies, go to either side by hash. Each shard builds a tree over its rows: first by label, until
nodes have one label, then by the direction of greatest width, to leaves of ``LEAF`` rows. A node knows a centre, a radius and
its range of labels. Anchors that fall into the same shard form blocks of ``BLOCK``, each with a tree of its own.

For an anchor node and a candidate node the inner products lie within ``c1.c2 +- (r1 |c2| + r2 |c1| + r1 r2)``. A pair of nodes whose interval lies under what
every anchor of the node already has (the k-th best score, at first that of the sample), or over all its windows, or whose labels cannot
match, goes as a whole; other pairs open their larger node, most promising first; pairs of leaves are scored exactly. A block whose interval with a
whole shard is pruned is not sent there. Sums are exact: doubles where they stay under 2^53, Python integers beyond.

Two searches: the ``positives`` best rows of the anchor's label, then for each anchor and positive the ``negatives`` best rows of other labels
within low % to high % of the positive's score. What shards find is merged by ranked windows, at most k rows a shard and anchor.

Rows with a null label, a null vector or null or non-finite components take no part. Only vectors of equal length meet. Repeated rows are
rows of their own: each is an anchor, and another positive or negative. A null vec_id comes last among equal scores and is no anchor. Scores beyond
64 bits are clipped. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SAMPLE = 4096
SHARDS = 8
#: Components (rows times length) of a shard, which bound a task's memory.
CELLS = 4_000_000
BLOCK = 128
#: Blocks of anchors that one task takes through a shard.
TOGETHER = 256
LEAF = 256
ANCHOR_LEAF = 16
EXACT = float(1 << 53)


def split(x: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(direction, threshold, goes right) that halve points along about their greatest width; equal ones by ``ties``."""
    from_mean = x - x.mean(0)
    far = from_mean[np.einsum("nd,nd->n", from_mean, from_mean).argmax()] if len(x) else np.zeros(x.shape[1])
    other = from_mean - far
    direction = other[np.einsum("nd,nd->n", other, other).argmax()] if len(x) else far
    at = x @ direction
    cut = float(np.median(at)) if len(at) else 0.0
    return direction, cut, sides(x, direction, cut, ties)


def sides(x: np.ndarray, direction: np.ndarray, cut: float, ties: np.ndarray) -> np.ndarray:
    at = x @ direction
    return np.where(np.isclose(at, cut, rtol=1e-12, atol=0), ties, at > cut).astype(bool)


def planes(x: np.ndarray, deep: int) -> list[tuple[np.ndarray, float]]:
    """A full tree of ``deep`` levels of hyperplanes, in heap order."""
    parts, out = [x], []
    for _ in range(deep):
        halves = []
        for p in parts:
            direction, cut, right = split(p, np.arange(len(p)) % 2 == 1)
            out.append((direction, cut))
            halves += [p[~right], p[right]]
        parts = halves
    return out


def routed(x: np.ndarray, ties: np.ndarray, tree: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Leaf of each row; ``ties`` are hashes whose bits decide equal projections."""
    node = np.zeros(len(x), np.int64)
    deep = (len(tree) + 1).bit_length() - 1
    for level in range(deep):
        for one in np.unique(node):
            rows = np.flatnonzero(node == one)
            node[rows] = 2 * one + 1 + sides(x[rows], *tree[one], (ties[rows] >> level & 1).astype(bool))
    return node - len(tree)


def grown(x: np.ndarray, label: np.ndarray, leaf: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of rows, nodes): a node's rows are order[begin:end]; children are -1 in leaves."""
    x = x.astype(np.float64)
    order = np.argsort(label, kind="stable")
    kinds = ("begin", "end", "left", "right", "least", "most", "radius")
    nodes: dict[str, list] = {k: [] for k in (*kinds, "centre")}

    def add(begin: int, end: int) -> int:
        rows = order[begin:end]
        centre = x[rows].mean(0)
        away = x[rows] - centre
        for k, v in zip((*kinds, "centre"), (begin, end, -1, -1, label[rows].min(), label[rows].max(), np.sqrt(np.einsum("nd,nd->n", away, away).max()), centre), strict=True):
            nodes[k].append(v)
        return len(nodes["begin"]) - 1

    todo = [add(0, len(x))]
    while todo:
        node = todo.pop()
        begin, end = nodes["begin"][node], nodes["end"][node]
        if end - begin <= leaf:
            continue
        rows = order[begin:end]
        if nodes["least"][node] < nodes["most"][node]:
            right = label[rows] > np.partition(label[rows], (len(rows) - 1) // 2)[(len(rows) - 1) // 2]
            if not right.any():
                right = label[rows] == nodes["most"][node]
        else:
            _, _, right = split(x[rows], np.arange(len(rows)) % 2 == 1)
        if right.all() or not right.any():
            right = np.arange(len(rows)) % 2 == 1
        order[begin:end] = np.concatenate([rows[~right], rows[right]])
        middle = begin + int((~right).sum())
        nodes["left"][node], nodes["right"][node] = add(begin, middle), add(middle, end)
        todo += [nodes["left"][node], nodes["right"][node]]
    return order, {k: np.array(v) for k, v in nodes.items()}


def intervals(a: dict[str, np.ndarray], c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between every node of one tree and every node of another."""
    na, nc = (np.sqrt(np.einsum("nd,nd->n", t["centre"], t["centre"])) for t in (a, c))
    wide = np.outer(a["radius"], nc) + np.outer(na, c["radius"]) + np.outer(a["radius"], c["radius"])
    middle = a["centre"] @ c["centre"].T
    slack = 1e-9 * np.outer(na + a["radius"], nc + c["radius"]) + 1e-6
    return middle - wide - slack, middle + wide + slack


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles if no sum can reach 2^53, else Python integers."""
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)))
    bound = float(np.abs(a.astype(np.float64)).sum(1).max()) * float(np.abs(c.astype(np.float64)).max())
    if bound < EXACT:
        return a.astype(np.float64) @ c.astype(np.float64).T
    return a.astype(object) @ c.astype(object).T


def down(x) -> np.ndarray:
    """As doubles, those beyond 2^53 rounded down, so that a bound stays one."""
    f = np.asarray(x).astype(np.float64)
    return np.where(np.abs(f) < EXACT, f, np.where(np.isinf(f), f, np.nextafter(f, -np.inf)))


def clipped(score) -> int:
    return int(min(max(int(score), -(1 << 63) + 1), (1 << 63) - 1))


class Best:
    """For each of ``n`` questions the k best (score, place) so far, and a bound under which nothing is wanted."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.found, self.bound = k, [[] for _ in range(n)], floor.copy()

    def put(self, q: int, scores, places) -> None:
        """Places are in the order in which equal scores rank."""
        both = sorted([*self.found[q], *zip((-s for s in scores), places, strict=True)])[: self.k]
        self.found[q] = both
        if len(both) == self.k:
            self.bound[q] = max(self.bound[q], float(down(-both[-1][0])))


def walk(a: dict, c: dict, open_pair, leaf_pair) -> None:
    """Node pairs from the roots on, those of highest bound first; ``open_pair`` says whether one is still wanted."""
    low, high = intervals(a, c)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        if not open_pair(i, j, low[i, j], high[i, j]):
            continue
        ends_a, ends_c = a["left"][i] < 0, c["left"][j] < 0
        if ends_a and ends_c:
            leaf_pair(slice(a["begin"][i], a["end"][i]), slice(c["begin"][j], c["end"][j]))
        elif ends_c or not ends_a and a["end"][i] - a["begin"][i] > c["end"][j] - c["begin"][j]:
            todo += sorted(((int(n), j) for n in (a["left"][i], a["right"][i])), key=lambda p: high[p])
        else:
            todo += sorted(((i, int(n)) for n in (c["left"][j], c["right"][j])), key=lambda p: high[p])


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(max(x.max(initial=0), -(x.min(initial=0) + 1)))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    rows = column.to_list()
    return np.array([np.asarray(r, np.int64) for r in rows], np.int64).reshape(len(rows), -1)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's tree."""
    # In this order equal scores rank: by vec_id, null last.
    rows = rows.sort_values(["named", "vec_id", "row"], ascending=[False, True, True])
    x, label = _matrix(rows["v"]), rows["label"].to_numpy()
    order, nodes = grown(x, label, LEAF)
    blob = _saved(x=_narrow(x[order]), label=label[order], row=rows["row"].to_numpy()[order], vec_id=rows["vec_id"].fillna(0).to_numpy().astype(np.int64)[order], named=rows["named"].to_numpy()[order], rank=order, **nodes)
    one = {k: nodes[k][:1] for k in nodes}
    return pd.DataFrame({"dim": rows["dim"].iloc[:1].to_numpy(), "shard": rows["shard"].iloc[:1].to_numpy(), "root": [_saved(**one)], "blob": [blob]})


def _loaded(blob: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(blob)))


def same_label(a: dict, c: dict, positives: int) -> Iterator[tuple]:
    """(anchor row, row, vec_id, score) of the best rows of each anchor's label in a shard."""
    best = Best(len(a["x"]), positives, a["floor"])

    def wanted(i: int, j: int, _: float, high: float) -> bool:
        return a["least"][i] <= c["most"][j] and c["least"][j] <= a["most"][i] and high >= min(best.bound[a["begin"][i] : a["end"][i]])

    def scored(p: slice, q: slice) -> None:
        s = products(a["x"][p], c["x"][q])
        fits = (a["label"][p, None] == c["label"][None, q]) & (a["row"][p, None] != c["row"][None, q])
        fits &= s >= best.bound[p, None]
        for k in np.flatnonzero(fits.any(1)).tolist():
            at = np.flatnonzero(fits[k])
            best.put(p.start + k, s[k, at].tolist(), zip(c["rank"][q][at].tolist(), (at + q.start).tolist(), strict=True))

    walk(a, c, wanted, scored)
    for k, found in enumerate(best.found):
        for less, (_, at) in found:
            yield int(a["row"][k]), int(c["row"][at]), int(c["vec_id"][at]) if c["named"][at] else None, clipped(-less)


def other_labels(a: dict, c: dict, negatives: int) -> Iterator[tuple]:
    """(anchor row, which positive, row, vec_id, score) of the best rows of other labels in each anchor's windows."""
    windows = a["low"].shape[1]
    best = Best(a["low"].size, negatives, a["floor"].ravel())
    top = a["high"].max(1)

    def wanted(i: int, j: int, low: float, high: float) -> bool:
        if a["least"][i] == a["most"][i] == c["least"][j] == c["most"][j]:
            return False
        b, e = a["begin"][i], a["end"][i]
        return low <= top[b:e].max() and high >= min(best.bound[b * windows : e * windows])

    def scored(p: slice, q: slice) -> None:
        s = products(a["x"][p], c["x"][q])
        fits = a["label"][p, None] != c["label"][None, q]
        for w in range(windows):
            bound = best.bound[p.start * windows + w : p.stop * windows : windows]
            inside = fits & (s <= a["high"][p, w, None]) & (s >= bound[:, None]) & (a["low"][p, w] <= a["high"][p, w])[:, None]
            for k in np.flatnonzero(inside.any(1)).tolist():
                at = np.flatnonzero(inside[k])
                if len(at) > 4 * negatives:  # of so many, those that can be among the best, ties included
                    at = at[s[k, at] >= np.sort(s[k, at])[-negatives]]
                best.put((p.start + k) * windows + w, s[k, at].tolist(), zip(c["rank"][q][at].tolist(), (at + q.start).tolist(), strict=True))

    walk(a, c, wanted, scored)
    for k, found in enumerate(best.found):
        for less, (_, at) in found:
            yield int(a["row"][k // windows]), k % windows, int(c["row"][at]), int(c["vec_id"][at]) if c["named"][at] else None, clipped(-less)


def _bounds(block: dict, x: np.ndarray, label: np.ndarray, row: np.ndarray, k: int) -> None:
    """Sets the block's floors: what the sample already offers each anchor, so that shards begin with a bound."""
    s = products(block["x"], x)
    same = block["label"][:, None] == label[None, :]

    def kth(fits: np.ndarray) -> np.ndarray:
        held = np.where(fits, s, -np.inf)
        return np.sort(held, axis=1)[:, -k] if held.shape[1] >= k else np.full(len(held), -np.inf)

    if "low" in block:
        sets = [np.maximum(down(kth(~same & (s >= block["low"][:, w, None]) & (s <= block["high"][:, w, None]))), down(block["low"][:, w])) for w in range(block["low"].shape[1])]
        block["floor"] = np.stack(sets, 1)
        block["floor"][block["low"] > block["high"]] = np.inf  # an empty window wants nothing
    else:
        block["floor"] = down(kth(same & (block["row"][:, None] != row[None, :])))


def _window(scores: list[int], low: int, high: int, many: int) -> tuple[list, list]:
    """Integer bounds of low % to high % of each score; empty ones for scores there are not."""
    some = [(-(-low * s // 100), high * s // 100) for s in scores] + [(1, 0)] * (many - len(scores))
    return [b for b, _ in some], [e for _, e in some]


def prepared(vectors: DataFrame, label: Column, component) -> DataFrame:
    """row, vec_id, label, dim, v of the rows that take part; ``component`` makes a component an integer."""
    v = F.transform("embedding", lambda x: component(x.cast("double")))
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select("vec_id", label.cast("long").alias("label"), "embedding").where(F.col("label").isNotNull() & usable)
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("embedding").alias("dim"), v.cast("array<long>").alias("v")))  # once written, rows keep their numbers


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` as ``prepared`` gives them."""
    spark = rows.sparkSession
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row for each length of vectors
    hashed = F.xxhash64("vec_id", "label", "v")
    sampled = rows.withColumn("_place", F.row_number().over(Window.partitionBy("dim").orderBy(hashed, "row"))).where(F.col("_place") <= SAMPLE).drop("_place").toPandas()
    samples = {int(d): (_matrix(p["v"]), p["label"].to_numpy(), p["row"].to_numpy()) for d, p in sampled.groupby("dim")}
    deep = {d: max(max(shards, -(-n * max(d, 1) // cells)) - 1, 0).bit_length() if n > LEAF else 0 for d, n in sizes.items()}
    trees = spark.sparkContext.broadcast({d: planes(x.astype(np.float64), deep[d]) for d, (x, _, _) in samples.items()})
    known = spark.sparkContext.broadcast(samples)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("dim"):
                shard = routed(_matrix(part["v"]).astype(np.float64), part["tie"].to_numpy(), trees.value[d])
                yield part.drop(columns="tie").assign(shard=shard.astype(np.int32), named=part["vec_id"].notna())

    kinds = "row long, vec_id long, label long, dim int, v array<long>, shard int, named boolean"
    dealt = written(rows.select("row", F.col("vec_id").cast("long").alias("vec_id"), "label", "dim", "v", F.xxhash64("row").alias("tie")).mapInPandas(route, kinds))
    trees_of = written(dealt.groupBy("dim", "shard").applyInPandas(_index, "dim int, shard int, root binary, blob binary"))
    roots = spark.sparkContext.broadcast({(r.dim, r.shard): _loaded(r.root) for r in trees_of.select("dim", "shard", "root").collect()})  # a row a shard: its centre and radius
    anchors = written(dealt.where(anchor))
    count = anchors.count()
    slices = -(-count // (BLOCK * TOGETHER)) or 1

    def blocks(k: int):
        def block(part: pd.DataFrame) -> pd.DataFrame:
            x, label = _matrix(part["v"]), part["label"].to_numpy()
            d = int(part["dim"].iloc[0])
            every, _ = grown(x, label, BLOCK)
            out = []
            for begin in range(0, len(part), BLOCK):
                some = every[begin : begin + BLOCK]
                order, nodes = grown(x[some], label[some], ANCHOR_LEAF)
                some = some[order]
                one = {"x": _narrow(x[some]), "label": label[some], "row": part["row"].to_numpy()[some], **nodes}
                if "scores" in part:
                    bounds = [_window([int(s) for s in part["scores"].iloc[i]], low, high, positives) for i in some]
                    one |= {"low": np.array([b for b, _ in bounds], np.int64).reshape(-1, positives), "high": np.array([e for _, e in bounds], np.int64).reshape(-1, positives)}
                _bounds(one, *known.value[d], k)
                least, blob = min(one["floor"].ravel().tolist()), None
                for (dim, shard), root in roots.value.items():
                    if dim == d and intervals({"centre": nodes["centre"][:1], "radius": nodes["radius"][:1]}, root)[1][0, 0] >= least:
                        blob = blob or _saved(**one)
                        out.append((d, shard, int(one["row"][0] % slices), blob))
            return pd.DataFrame(out, columns=["dim", "shard", "slice", "blob"])

        return block

    copies = trees_of.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "blob")

    def met(asked: DataFrame, k: int, search, kinds: str, columns: list[str]) -> DataFrame:
        def ask(held: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(questions):
                return pd.DataFrame(columns=columns)
            c = _loaded(held["blob"].iloc[0])
            return pd.DataFrame([r for q in questions["blob"] for r in search(_loaded(q), c, k)], columns=columns)

        sent = asked.groupBy("dim", "shard").applyInPandas(blocks(k), "dim int, shard int, slice int, blob binary")
        keys = ("dim", "shard", "slice")
        return copies.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(ask, kinds)

    def ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = met(anchors, positives, same_label, "anchor long, row long, vec_id long, score long", ["anchor", "row", "vec_id", "score"])
    near = written(ranked(near, ["anchor"], positives))
    scores = near.groupBy(F.col("anchor").alias("_row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda r: r["score"]).alias("scores"))
    asked = anchors.join(scores, F.col("row") == F.col("_row")).drop("_row")
    far = met(asked, negatives, other_labels, "anchor long, place int, row long, vec_id long, score long", ["anchor", "place", "row", "vec_id", "score"])
    far = ranked(far, ["anchor", "place"], negatives).withColumn("place", F.col("place") + 1)
    chosen = near.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = far.join(chosen, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
