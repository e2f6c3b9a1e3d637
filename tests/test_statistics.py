import numpy as np
import pytest

from kinetrail.operators import lookups, metrics, sharding


def test_quantiles_like_numpy(spark):
    values = np.random.default_rng(2).normal(size=(501, 2))
    df = spark.createDataFrame([([*map(float, v), None],) for v in values] + [(None,)], "a array<double>")
    got = {r.joint: r[1:] for r in metrics.norm_stats(df, "a").collect()}
    for j in (0, 1):
        assert got[j] == pytest.approx([round(np.quantile(values[:, j], q) * 128) / 128 for q in (0, 0.01, 0.99, 1)])
    assert got[2] == (None,) * 4 and len(got) == 3


def test_deep_transform_trees_are_refused(spark):
    one = [float(v) for v in np.eye(4).ravel()]
    edges = spark.createDataFrame([(str(k), str(k + 1), one) for k in range(4)], "parent string, child string, matrix array<double>")
    assert lookups.transform_paths(edges, "0", 5).count() == 4
    with pytest.raises(ValueError, match="levels"):
        lookups.transform_paths(edges, "0", 2)


def test_mix_follows_weights_and_loses_nothing(spark):
    parts = [spark.range(400).withColumnRenamed("id", "pos"), spark.range(400).withColumnRenamed("id", "pos")]
    mix = sharding.mixed(parts, [3.0, 1.0], 5)
    rows = [(r.source, r.pos) for r in mix.orderBy("mix_key", "source", "pos").collect()]
    assert sorted(rows) == [(s, k) for s in (0, 1) for k in range(400)]
    for n in (100, 200, 400):
        assert sum(s == 0 for s, _ in rows[:n]) == pytest.approx(0.75 * n, abs=4)
    assert [k for s, k in rows if s == 0] != list(range(400))
    assert rows == [(r.source, r.pos) for r in sharding.mixed(parts, [3.0, 1.0], 5).orderBy("mix_key", "source", "pos").collect()]
