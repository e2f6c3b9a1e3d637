import hashlib
import random
from collections import Counter

from kinetrail.llm import suffixes

from .common_cases import clashing, corpus, rows_of, sentence, table


def brute(rows):
    width = suffixes.LENGTH
    seen = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        seen.update(raw[i : i + width] for i in range(len(raw) - width + 1))
    out = []
    for r in rows:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if seen[raw[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((r[0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = corpus(11, 50)
    rng = random.Random(6)
    passage = sentence(rng, 200)
    for k in range(40):  # parts of a passage, cut at all places, some with changed bytes
        a, n = rng.randrange(1200), rng.randrange(150, 700)
        part = passage[a : a + n]
        if k % 3 == 0 and len(part) > 100:
            part = part[:90] + "#" + part[91:]
        rows.append((200 + k, f"{sentence(rng, rng.randrange(9))}{part}{sentence(rng, rng.randrange(9))}", "en", "x", 0))
    rows.append((300, "ab" * 900, "en", "x", 0))  # repeats itself
    rows.append((301, "é" * 450 + passage[:300] + "漢" * 100, "en", "x", 0))
    rows.append((302, passage[100:299], "en", "x", 0))  # a byte too short
    rows.append((303, passage[100:300], "en", "x", 0))
    rows.append((304, f"{passage[:250]} between {passage[:250]}", "en", "x", 0))
    assert rows_of(suffixes.digested(clashing(table(spark, rows)))) == brute(rows)


def test_many_copies_over_many_partitions(spark):
    rng = random.Random(7)
    hot = sentence(rng, 60)
    rows = [(k, f"{sentence(rng, 5)} {hot} {sentence(rng, 5)}", "en", "x", 0) for k in range(300)]
    rows += [(1000 + k, hot + hot, "en", "x", 0) for k in range(50)] + [(1, None, None, None, None), (1, "", None, None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert rows_of(suffixes.digested(table(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table(spark):
    assert suffixes.digested(table(spark, [])).collect() == []


def test_multikey_quicksort():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 20_000), rng.integers(0, 50, 20_000), rng.integers(0, 9, 20_000)]
    order = suffixes.multikey_quicksort(columns)
    want = np.lexsort(columns[::-1])
    assert all((c[order] == c[want]).all() for c in columns)
