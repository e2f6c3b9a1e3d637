import random

import numpy as np
import xxhash

from kinetrail.llm import simhash
from kinetrail.llm.common import components

from .common_cases import clashing, components_of, corpus, rows_of, table


def fingerprint(text):
    """Bit by bit, as the contract says."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_components(spark):
    rows = corpus(9, 150)
    rng = random.Random(1)
    long = [w for w in rows[9][1].split()]
    for k in range(30):  # near copies of a long text: few bits apart
        some = list(long)
        for _ in range(k):
            some[rng.randrange(len(some))] = f"n{k}"
        rows.append((500 + k, " ".join(some), "en", "x", 0))
    got = simhash.simhash(clashing(table(spark, rows)))
    fps = {r[0]: fingerprint(r[1]) for r in rows}
    want = components_of(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert rows_of(got) == sorted(((r[0], f"{fps[r[0]]:016x}", want[r[0]]) for r in rows), key=repr)


def test_golay_keys_miss_no_link():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for row in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[row] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for x in (a, b):
        rows, key = simhash.keys(x.view(np.int64))
        keys.append({(r, k) for r, k in zip(rows.tolist(), key.tolist(), strict=True)})
    assert {r for r, _ in keys[0] & keys[1]} == set(range(len(a)))


def test_hot_keys_are_cut_into_blocks(spark):
    rng = random.Random(5)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(400)})
    df = spark.createDataFrame([(f - (1 << 64) * (f >> 63),) for f in fps], "fp long")
    want = components_of(range(len(fps)), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    at = {f - (1 << 64) * (f >> 63): i for i, f in enumerate(fps)}
    for run in (40, 20_000):
        found = [(at[r.a], at[r.b]) for r in simhash.link(df, run=run).collect()]
        assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in found)
        linked = {frozenset(p) for p in found}
        assert components_of(range(len(fps)), lambda i, j: frozenset((i, j)) in linked) == want  # noqa: B023


def test_one_document_of_each_group_stays(spark):
    rows = corpus(10, 80)
    docs = clashing(table(spark, rows))
    kept = simhash.one_each(docs)
    want = {c for c in rows_of(simhash.simhash(docs).select("component_id").distinct())}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(c[0] for c in want)


def test_empty_table_and_components_of_a_path(spark):
    assert simhash.simhash(table(spark, [])).collect() == []
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(path).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
