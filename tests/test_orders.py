"""Random orders row by row, against the same hashes sorted on the driver."""

from collections import Counter

from pyspark.sql import functions as F

from kinetrail.operators import sharding


def placed(spark, n):
    return spark.range(n).withColumnRenamed("id", "pos")


def hashes(df, seed):
    return {r.pos: r.h for r in df.select("pos", F.xxhash64(F.lit(seed), "pos").alias("h")).collect()}


def test_shuffled_rows(spark):
    df = placed(spark, 500)
    h = hashes(df, 12)
    got = {r.pos: r.shuffled for r in sharding.shuffled(df, 11).collect()}
    assert got == {pos: k for k, pos in enumerate(sorted(range(500), key=lambda p: (h[p], p)))}
    chunks = {r.pos: r.h for r in df.select("pos", F.xxhash64(F.lit(11), F.floor(F.col("pos") / 7)).alias("h")).collect()}
    got = {r.pos: r.shuffled for r in sharding.shuffled(df, 11, chunk=7).collect()}
    assert got == {pos: k for k, pos in enumerate(sorted(range(500), key=lambda p: (chunks[p], h[p], p)))}
    assert got != {p: p for p in range(500)}


def test_resampled_rows(spark):
    df = placed(spark, 200)
    h = hashes(df, 5)
    got = Counter((r.pos, r["pass"]) for r in sharding.resampled(df, 2.375, 5).collect())
    more = sorted(range(200), key=lambda p: (h[p], p))[:75]
    assert got == Counter([(p, k) for p in range(200) for k in (1, 2)] + [(p, 3) for p in more])


def test_mixed_rows(spark):
    sources, weights = [placed(spark, 40), placed(spark, 90)], [1.0, 2.0]
    got = {(r.source, r.pos): r.mix_key for r in sharding.mixed(sources, weights, 3).collect()}
    want = {}
    for k, (df, weight) in enumerate(zip(sources, weights, strict=True)):
        rows = df.select("pos", F.xxhash64(F.lit(3), F.lit(k), "pos").alias("h")).withColumn("u", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 30)) / float(1 << 30))
        for rank, r in enumerate(sorted(rows.collect(), key=lambda r: (r.h, r.pos))):
            want[k, r.pos] = (rank + r.u) / weight
    assert got == want
    order = [s for (s, _), _ in sorted(got.items(), key=lambda x: x[1])]
    assert abs(order[:60].count(1) - 40) <= 2  # twice the weight, twice the draws


def test_reservoir_order(spark):
    df = placed(spark, 2000).coalesce(1)
    got = [r.pos for r in sharding.reservoir_shuffled(df, 256, 32, 5).collect()]
    assert sorted(got) == list(range(2000)) and got != sorted(got)
    assert got == [r.pos for r in sharding.reservoir_shuffled(df, 256, 32, 5).collect()]
    # No row leaves before it was read, and most do not stay where they were.
    assert all(pos < 256 + 32 * (k // 32 + 1) for k, pos in enumerate(got[: 2000 - 256]))
    assert sum(abs(pos - k) > 20 for k, pos in enumerate(got)) > 1000
