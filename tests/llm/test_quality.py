import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from kinetrail.llm import quality

from .common_cases import clashing, corpus, rows_of, table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    ws, text = words(text), text or ""
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def cells(ws, buckets):
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ws]
    two = [xxhash.xxh64_intdigest(ws[i + 1].encode(), h) if i + 1 < len(ws) else h for i, h in enumerate(one)]
    return [h % buckets for h in one] + [h % buckets + buckets for h in two]


def brute(docs, good, buckets=quality.BUCKETS):
    raw, trusted = Counter(), Counter()
    for r in docs:
        raw.update(cells(words(r[1]), buckets))
        if r[0] in good:
            trusted.update(cells(words(r[1]), buckets))
    share = sum(trusted.values()) / max(sum(raw.values()), 1)
    s = quality.SMOOTHING
    weight = {c: math.log(trusted[c] + s) - math.log(raw[c] * share + s) if share else 0.0 for c in raw}
    out = []
    for r in docs:
        b, ws = base(r[1]), words(r[1])
        score = sum(weight[c] for c in cells(ws, buckets)) / (2 * len(ws)) if ws else 0.0
        out.append((r[0], *b, not b[-1] and score >= quality.THRESHOLD, round(score, 9)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = corpus(2)
    rows += [(100 + k, "a b c d e a b c d e x #1 y <z> w | q r s t u v", "en", "x", 1) for k in range(3)]
    good = {1, 2, 5, 100, 999}
    trusted = spark.createDataFrame([(g,) for g in good] + [(2,), (None,)], "doc_id long")
    got = quality.quality(clashing(table(spark, rows)), trusted)
    assert rows_of(got.withColumn("score", F.round("score", 9))) == brute(rows, good)


def test_stage_keeps_columns_and_repeats(spark):
    rows = corpus(3)
    docs = clashing(table(spark, rows))
    trusted = spark.createDataFrame([(2,), (9,)], "doc_id long")
    kept = quality.keep(docs, trusted)
    assert kept.columns == docs.columns
    verdict = {r[0]: r[-2] for r in brute(rows, {2, 9})}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if verdict[r[0]])


def test_empty_tables(spark):
    none = table(spark, [])
    ids = spark.createDataFrame([], "doc_id long")
    assert quality.quality(none, ids).collect() == []
    (one,) = quality.quality(table(spark, [(1, "w " * 30, None, None, None)]), ids).collect()
    assert one.score == 0.0 and one.base_failed


def test_no_python_in_the_plan(spark):
    plan = quality.quality(table(spark, corpus(4)), spark.createDataFrame([(1,)], "doc_id long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
