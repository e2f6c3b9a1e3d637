import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import dualtree, queries
from tests.oracle import differences

from .common_cases import clashing, rows_of

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=10, low=30, high=90, every=3):
    known = [(k, i, label, [math.floor(256 * x) for x in v]) for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: max(min(sum(x * y for x, y in zip(a, b, strict=True)), (1 << 63) - 1), -(1 << 63) + 1)
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, i, label, v in known:
        if i is None or i % every:
            continue
        met = [(score(v, w), j, other == label) for m, j, other, w in known if m != k and len(w) == len(v)]
        for p, positive, _ in sorted((r for r in met if r[2]), key=order)[:positives]:
            fit = sorted((r for r in met if not r[2] and low * p <= 100 * r[0] <= high * p), key=order)[:negatives]
            out += [(i, positive, rank + 1, r[1], p, r[0]) for rank, r in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, every=3, **parameters):
    df = clashing(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "own")).withColumn("label", F.col("own"))
    known = dualtree.prepared(df, F.col("label"), lambda x: F.floor(256 * x))
    return rows_of(dualtree.hard_negatives(known, F.col("vec_id") % every == 0, **parameters))


def clustered(seed, n, width, labels):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    return [(k, (centres[k % 12] + 0.3 * rng.standard_normal(width)).tolist(), int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize(("width", "labels", "shards"), [(6, 4, 8), (2, 3, 4), (16, 40, 1)])
def test_against_brute_force(spark, monkeypatch, width, labels, shards):
    monkeypatch.setattr(dualtree, "LEAF", 20)
    monkeypatch.setattr(dualtree, "BLOCK", 16)
    rows = clustered(width, 500, width, labels)
    want = brute(rows)
    assert want and mined(spark, rows, shards=shards) == want


def test_ties_copies_nulls_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "LEAF", 16)
    rows = clustered(3, 120, 3, 3)
    nan, inf = float("nan"), float("inf")
    rows += [(200 + k, [0.5, 0.25, 0.125], 0) for k in range(60)] + [(300 + k, [0.25, 0.25, 0.125], 1) for k in range(60)]
    rows += [(401, None, 1), (402, [nan, 1.0, 1.0], 1), (403, [inf, 1.0, 1.0], 1), (404, [None, 1.0, 1.0], 1), (405, [1.0, 1.0, 1.0], None)]
    rows += [(None, [0.4, 0.25, 0.1], 1), (None, [0.5, 0.25, 0.125], 0), (406, [], 1), (408, [], 1), (411, [1.0, 2.0], 1), (414, [1.0, 2.1], 1), (415, [0.5, 1.0], 2), rows[3], rows[9]]
    assert mined(spark, rows, shards=4) == brute(rows)


def test_sums_beyond_doubles(spark):
    rows = [(3 * k, [1e6 + k, 1e7 - 3 * k, 7.0 * k], k % 2) for k in range(20)] + [(1, [6e5, 6e6, 0.0], 0), (2, [5e5, 5e6, 3.0], 1)]
    assert mined(spark, rows) == brute(rows)


def test_nodes_are_pruned_and_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.integers(-9, 9, (400, 8)) for c in 100 * rng.integers(-9, 9, (20, 8))]).astype(np.int64)
    label = np.repeat(np.arange(20) % 4, 400)
    order, nodes = dualtree.grown(x, label, 64)
    low, high = dualtree.intervals(nodes, nodes)
    for i in range(0, len(nodes["begin"]), 7):
        for j in range(0, len(nodes["begin"]), 5):
            s = x[order[nodes["begin"][i] : nodes["end"][i]]] @ x[order[nodes["begin"][j] : nodes["end"][j]]].T
            assert low[i, j] <= s.min() and s.max() <= high[i, j]
    c = {"x": x[order], "label": label[order], "row": order, "vec_id": order, "named": np.ones(len(x), bool), "rank": order, **nodes}
    some = rng.permutation(len(x))[:800]
    own, small = dualtree.grown(x[some], label[some], 4)
    some = some[own]
    a = {"x": x[some], "label": label[some], "row": some, "floor": np.full(len(some), -np.inf), **small}
    scored = []
    monkey = dualtree.products
    dualtree.products = lambda p, q: scored.append(len(p) * len(q)) or monkey(p, q)
    try:
        found = list(dualtree.same_label(a, c, 5))
    finally:
        dualtree.products = monkey
    assert len(found) == 5 * len(some) and sum(scored) < 0.1 * len(x) * len(some)


def test_same_rows_as_sql(spark):
    for sf in ("sf0.001", "sf0.1"):
        assert differences(spark, f"/root/testdata/{sf}", queries.op12_hard_negatives, queries.OP12_SQL) == []


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
