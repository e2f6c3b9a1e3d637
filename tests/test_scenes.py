import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import geometry, scenes
from kinetrail.operators import imports
from kinetrail.sources import mcap


def turn(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, [1, 0, 2]]


def box(centre, size, rotation):
    return [float(v) for v in (*centre, *size, *np.asarray(rotation).ravel())]


def test_rotated_boxes(spark):
    rng, c = np.random.default_rng(3), math.cos(math.pi / 4)
    eighth = [c, -c, 0, c, c, 0, 0, 0, 1]
    rows = [(box([5, 5, 5], [1, 1, 1], np.eye(3)), box([5, 5, 5], [1, 1, 1], eighth)), (box([0] * 3, [1] * 3, np.eye(3)), box([0] * 3, [1] * 3, np.eye(3))), (box([0] * 3, [1] * 3, np.eye(3)), box([9] * 3, [1] * 3, eighth)), (None, box([0] * 3, [1] * 3, eighth))]
    pairs = [(box(rng.normal(size=3) * 0.3, rng.uniform(0.5, 2, 3), turn(rng)), box(rng.normal(size=3) * 0.3, rng.uniform(0.5, 2, 3), turn(rng))) for _ in range(6)]
    df = spark.createDataFrame([*rows, *pairs], "a array<double>, b array<double>").coalesce(1)
    got = [r[0] for r in df.select(scenes.iou_rotated(F.col("a"), F.col("b"))).collect()]
    common = 2 * (math.sqrt(2) - 1)
    assert got[:3] == pytest.approx([common / (2 - common), 1, 0], abs=1e-9) and got[3] is None

    def inside(points, b):
        b = np.array(b)
        return (np.abs((points - b[:3]) @ b[6:].reshape(3, 3)) <= b[3:6] / 2).all(axis=1)

    points = rng.uniform(-3, 3, (400_000, 3))
    for (a, b), iou in zip(pairs, got[4:], strict=True):
        both, either = inside(points, a) & inside(points, b), inside(points, a) | inside(points, b)
        assert iou == pytest.approx(both.sum() / either.sum(), abs=0.03)


def test_views_and_angles(spark):
    x, y, z = (F.col(a) for a in "xyz")
    rows = scenes.viewpoints(spark, 40).union(spark.createDataFrame([(40, 0.0, 0.0, 2.0)], "view long, x double, y double, z double"))
    for r in rows.select("x", "y", "z", scenes.view_rotation([x, y, z], F.lit(0.7)).alias("m")).collect():
        m = np.array(r.m).reshape(3, 3)
        assert m @ m.T == pytest.approx(np.eye(3), abs=1e-9) and np.linalg.det(m) == pytest.approx(1)
        assert m[:, 0] == pytest.approx(np.array([r.x, r.y, r.z]) / math.sqrt(r.x**2 + r.y**2 + r.z**2))
    flat = geometry.pose_matrix(F.array(*[F.lit(0.0)] * 3), F.array(*map(F.lit, (1.0, 1.0, 0.0, 0.0))))
    assert spark.range(1).select(scenes.horizontal_angle(flat)).first()[0] == pytest.approx(0, abs=1e-6)


def test_clouds_move_as_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k % 3, *map(float, rng.normal(size=3))) for k in range(30)], "scene long, x double, y double, z double")
    got = scenes.cloud_augmented(df.withColumns({f"{a}0": F.col(a) for a in "xyz"}), ["scene"], 7).collect()
    assert got == scenes.cloud_augmented(df.withColumns({f"{a}0": F.col(a) for a in "xyz"}), ["scene"], 7).collect()
    for s in range(3):
        mine = [r for r in got if r.scene == s]
        before, after = (np.array([[r[a + e] for a in "xyz"] for r in mine]) for e in ("0", ""))
        assert np.linalg.norm(before[1:] - before[0], axis=1) == pytest.approx(np.linalg.norm(after[1:] - after[0], axis=1))
        assert not np.allclose(before, after)
    assert scenes.cloud_moved(df, F.array(*[F.lit(float(v)) for v in (1, 0, 0, 2, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])).agg(F.sum("x")).first()[0] == pytest.approx(df.agg(F.sum("x")).first()[0] + 60)


def test_collisions_in_turned_frames(spark):
    rng = np.random.default_rng(5)
    points = rng.uniform(-1, 1, (300, 3))
    grasps = [(k, *map(float, rng.uniform(-1, 1, 3)), [float(v) for v in turn(rng).ravel()]) for k in range(20)]
    g = spark.createDataFrame([(0, *r) for r in grasps] + [(1, 99, 0.0, 0.0, 0.0, grasps[0][4])], "scene long, g long, x double, y double, z double, r array<double>")
    p = spark.createDataFrame([(0, *map(float, v)) for v in points], "scene long, x double, y double, z double")
    regions = {"near": ([-0.3] * 3, [0.3] * 3), "ahead": ([0.0, -0.1, -0.2], [0.5, 0.1, 0.2])}
    got = {r.g: (r.near, r.ahead) for r in scenes.collision_counts(g, p, ["scene"], regions, "g", F.col("r")).collect()}
    for k, x, y, z, r in grasps:
        local = (points - [x, y, z]) @ np.array(r).reshape(3, 3)
        assert got[k] == tuple(int(((local >= lo) & (local <= hi)).all(axis=1).sum()) for lo, hi in regions.values())
    assert got[99] == (0, 0)


def test_falling_times_and_broken_messages(spark):
    df = spark.createDataFrame([(1, 1, 5, "{\"v\": 1}"), (1, 2, 4, "{")], "log long, n long, log_time long, data string").withColumn("topic", F.lit("a"))
    with pytest.raises(Exception, match="must not fall"):
        imports.ascending(df, "log", ["n"]).collect()
    assert [r.message.v for r in imports.decoded(df, "a", "v long", strict=False).orderBy("n").collect()] == [1, None]
    with pytest.raises(Exception, match="(?i)malformed"):
        imports.decoded(df, "a", "v long").collect()


def test_log_files_become_frames(spark, tmp_path):
    arm = [("arm", 10 * k, b'{"q": %d}' % (k // 2)) for k in range(10)]
    eye = [("eye", 25 * k + 1, b'{"name": "i%d"}' % k) for k in range(4)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.mcap").write_bytes(mcap.packed(sorted(arm + eye, key=lambda m: m[1])))
    messages = mcap.read(spark, str(tmp_path))
    got = imports.log_frames(messages, "path", ["log_time"], imports.Stream("arm", "q long", {"state": "q"}), [imports.Stream("eye", "name string", {"image": "name"})], 9, "state", 0)
    frames = got["frames"].orderBy("index").collect()
    assert [r.timestamp_min for r in frames] == [0, 20, 40, 60, 80] * 2 and [r.state for r in frames] == [0, 1, 2, 3, 4] * 2
    assert [r.image for r in frames] == ["i0", "i1", None, "i2", "i3"] * 2  # 40 is 11 from 51, 60 is 9


def test_suppression_like_one_by_one(spark):
    rng = np.random.default_rng(8)
    axis = [[float(v) for v in np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]).ravel()] for a in rng.uniform(0, 1.5, 240)]
    rows = [(k % 2, k, *map(float, rng.uniform(0, 0.4, 3)), float(rng.integers(0, 40)), axis[k]) for k in range(240)]
    df = spark.createDataFrame(rows, "scene long, g long, x double, y double, z double, score double, r array<double>")
    kept = []
    for row in sorted(rows, key=lambda r: (-r[5], r[1])):
        worse = (np.linalg.norm(np.subtract(row[2:5], k[2:5])) <= 0.12 and (np.dot(row[6], k[6]) - 1) / 2 >= math.cos(math.radians(30)) for k in kept if k[0] == row[0])
        if not any(worse):
            kept.append(row)
    got = scenes.suppressed(df, ["scene"], "g", "score", 0.12, 30, "r")
    assert sorted(r.g for r in got.collect()) == sorted(k[1] for k in kept) and len(kept) < 200
    assert scenes.suppressed(df.limit(0), ["scene"], "g", "score", 0.12, 30, "r").count() == 0


def test_transforms_are_compiled_and_equal_the_bound_form(spark):
    rows = [(k, "base", f"c{k % 3}", [1.0 * k, 2.0, -3.0], [0.5 + k, -0.25 * k, 1.0, 2.0]) for k in range(20)] + [(20, "base", "c", None, [1.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, parent string, child string, translation array<double>, rotation array<double>")
    got = imports.transforms_of(imports.transform_messages(df, "/tf", ["id"]), "/tf", ["id"])
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    bound = {r.id: r.m for r in df.select("id", geometry.pose_matrix(F.col("translation"), F.col("rotation")).alias("m")).collect()}
    matrices = {r.id: r.matrix for r in got.collect()}
    assert len(matrices) == 21 and all(matrices[k] == bound[k] for k in range(20))
    assert matrices[20][3] is None and matrices[20][0] == bound[20][0]
