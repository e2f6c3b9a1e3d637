import re
from collections import Counter, defaultdict

import pytest

from kinetrail.llm import mixing

from .common_cases import clashing, corpus, rows_of, table


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows):
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(total.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * total[s]
            left -= 2 * total[s]
        open_ -= over
    return total, out


def quotas(votes, seats):
    """Sainte-Lague by ranking every quotient."""
    got = Counter()
    for _ in range(seats):
        k = max(votes, key=lambda x: (votes[x] / (2 * got[x] + 1), -x))
        got[k] += 1
    return got


def test_targets_sizes_and_taken(spark):
    rows = corpus(5, 300)
    done = mixing.mix(clashing(table(spark, rows)), shard=500).collect()
    total, want = targets(rows)
    assert sorted((r.doc_id, r.size) for r in done) == sorted((r[0], size(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in done:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 16 * 4, s


def test_reruns_agree_under_another_partitioning(spark):
    docs = table(spark, corpus(6, 100))
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(7, "n_chars")))


def test_the_mix_itself_holds_what_is_taken(spark):
    docs = clashing(table(spark, corpus(7, 100)))
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += size(r.text)
    assert got == Counter({k: v for k, v in taken.items() if v})


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_sainte_lague_by_highest_quotients(spark, seats):
    votes = {1: 50.0, 2: 50.0, 3: 7.0, 4: 1.0, 5: 0.0, 6: 331.0}
    df = spark.createDataFrame([(1, k, v) for k, v in votes.items()], "g int, k int, v double")
    from pyspark.sql import functions as F

    got = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "v", F.lit(seats), ["k"]).collect()}
    assert got == {k: quotas(votes, seats)[k] for k in votes}


def test_empty_and_sizeless_tables(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    got = mixing.mix(table(spark, [(1, None, "e", None, 0), (2, " ", "e", "x", 0)])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
