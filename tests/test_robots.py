import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import depths, tables
from kinetrail.sources import robots

TWO_ARMS = """<robot name="two">
<link name="base"/><link name="l1"/><link name="l2"/><link name="l3"/><link name="tool"/><link name="r1"/><link name="r2"/><link name="finger"/><link name="other"/>
<joint name="j1" type="revolute"><parent link="base"/><child link="l1"/><origin xyz="0.1 0.2 0.3" rpy="0.3 -0.2 0.5"/><axis xyz="0 0 2"/><limit lower="-1" upper="2"/></joint>
<joint name="j2" type="continuous"><parent link="l1"/><child link="l2"/><origin xyz="0 0 1"/><axis xyz="0 1 0"/></joint>
<joint name="mount" type="fixed"><parent link="l2"/><child link="tool"/><origin xyz="0.5 0 0" rpy="0 1.5 0"/></joint>
<joint name="j3" type="prismatic"><parent link="tool"/><child link="l3"/></joint>
<joint name="k1" type="revolute"><parent link="base"/><child link="r1"/><axis xyz="1 1 0"/></joint>
<joint name="k2" type="revolute"><parent link="r1"/><child link="r2"/><origin xyz="1 0 0"/><axis xyz="0 0 1"/></joint>
<joint name="open" type="prismatic"><parent link="r2"/><child link="finger"/><axis xyz="0 1 0"/></joint>
<joint name="follow" type="prismatic"><parent link="r2"/><child link="other"/><axis xyz="0 -1 0"/><mimic joint="open" multiplier="2" offset="0.1"/></joint>
</robot>"""


def rot(axis, a):
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    c, s = np.cos(a), np.sin(a)
    t = 1 - c
    out = np.eye(4)
    out[:3, :3] = [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]
    return out


def move(x, y, z):
    out = np.eye(4)
    out[:3, 3] = (x, y, z)
    return out


def by_hand(q):
    l1 = move(0.1, 0.2, 0.3) @ rot((0, 0, 1), 0.5) @ rot((0, 1, 0), -0.2) @ rot((1, 0, 0), 0.3) @ rot((0, 0, 1), q["j1"])
    l2 = l1 @ move(0, 0, 1) @ rot((0, 1, 0), q["j2"])
    tool = l2 @ move(0.5, 0, 0) @ rot((0, 1, 0), 1.5)
    r1 = rot((1, 1, 0), q["k1"])
    r2 = r1 @ move(1, 0, 0) @ rot((0, 0, 1), q["k2"])
    return {"base": np.eye(4), "l1": l1, "l2": l2, "tool": tool, "l3": tool @ move(q["j3"], 0, 0), "r1": r1, "r2": r2, "finger": r2 @ move(0, q["open"], 0), "other": r2 @ move(0, -(2 * q["open"] + 0.1), 0)}


def test_poses_of_two_arms(spark):
    described = robots.joint_table(spark.createDataFrame([("two", TWO_ARMS), ("one", TWO_ARMS.replace('xyz="0 0 1"/><axis xyz="0 1 0"', 'xyz="0 0 2"/><axis xyz="0 1 0"'))], "name string, content string"))
    assert described.count() == 16 and described.where("joint = 'j1'").first().upper == 2
    rng = random.Random(1)
    states = [(k, "two", {j: rng.uniform(-2, 2) for j in ("j1", "j2", "j3", "k1", "k2", "open")}) for k in range(50)]
    states += [(50, "two", {"j1": 1.0}), (51, "none", states[0][2]), (52, "two", None), (53, "one", states[0][2])]
    df = spark.createDataFrame(states, "id int, robot string, q map<string, double>")
    got = {r.id: r.p for r in df.select("id", robots.link_poses(described, "robot", "q").alias("p")).collect()}
    for k, _, q in states[:50]:
        want = by_hand(q)
        assert set(got[k]) == set(want) and all(np.allclose(np.array(got[k][link]).reshape(4, 4), m) for link, m in want.items())
    assert got[50] is got[51] is got[52] is None and got[53]["l2"] != got[0]["l2"]
    some = df.limit(1).select(robots.link_poses(described, "robot", "q", ["tool"]).alias("p")).first().p
    assert list(some) == ["tool"]


def test_distances_of_joints(spark):
    joints = robots.joint_table(spark.createDataFrame([("two", TWO_ARMS)], "name string, content string"))
    got = {(r.a, r.b): r.distance for r in robots.joint_distances(joints).collect()}
    # Places on each arm; of two arms, one counts on below the other's first joint.
    left, right = ["j1", "j2", "j3"], ["k1", "k2", "open"]
    for arm in (left, right):
        assert all(got[a, b] == abs(i - j) for i, a in enumerate(arm) for j, b in enumerate(arm))
    assert all(got[a, b] == got[b, a] == i + j + 1 for i, a in enumerate(left) for j, b in enumerate(right))
    assert got["open", "follow"] == 1 and len(got) == 49


@pytest.mark.parametrize(("text", "why"), [("<robot", "two"), (TWO_ARMS.replace('child link="l2"', 'child link="l1"'), "tree"), (TWO_ARMS.replace('<link name="base"/>', '<link name="base"/><link name="lone"/>'), "2 links"), (TWO_ARMS.replace("continuous", "floating"), "kind floating"), (TWO_ARMS.replace('xyz="0 0 2"', 'xyz="0 0 0"'), "no axis")])
def test_broken_descriptions(text, why):
    with pytest.raises(robots.BrokenDescription, match=why):
        robots.parsed("two", text)


def brute_labels(image, strides, bins, least, most, soft):
    anchors = np.linspace(least, most, bins)
    d = np.clip(image, least, most)
    prob = np.maximum(0, 1 - np.abs(d[..., None] - anchors) / (anchors[1] - anchors[0]))
    if not soft:
        prob = np.eye(bins)[np.abs(d[..., None] - anchors).argmin(-1)]
    h, w = image.shape
    return np.concatenate([prob.reshape(h // s, s, w // s, s, bins).mean((1, 3)).reshape(-1, bins) for s in strides])


@pytest.mark.parametrize("soft", [True, False])
def test_depth_bins(spark, soft):
    rng = np.random.default_rng(2)
    images = rng.uniform(-1, 12, (20, 8, 16))
    images[0] = 0.25
    images[1] = 10
    rows = [(k, m.ravel().tolist()) for k, m in enumerate(images)] + [(20, None), (21, [1.0]), (22, [None] * 128)]
    df = spark.createDataFrame(rows, "id int, d array<double>")
    got = {r.id: r.y for r in df.select("id", depths.bin_labels("d", 8, 16, (2, 4, 8), 16, soft=soft).alias("y")).collect()}
    for k, m in enumerate(images):
        assert np.allclose(got[k], brute_labels(m, (2, 4, 8), 16, 0.25, 10.0, soft), atol=1e-5)
    assert got[20] is got[21] is got[22] is None
    with pytest.raises(ValueError, match="do not divide"):
        depths.bin_labels("d", 8, 16, (3,))


def test_nearest_depths(spark):
    points = [(1, 0.5, 0.2, 3.0), (1, 0.9, 0.9, 2.0), (1, 0.1, 0.1, -1.0), (1, 3.0, 1.0, 5.0), (1, 4.0, 0.0, 1.0), (1, -0.1, 0.0, 1.0), (2, 2.5, 1.5, 7.0)]
    df = spark.createDataFrame(points, "view int, u double, v double, d double")
    got = {r.view: r.depths for r in depths.nearest_depths(df, ["view"], "u", "v", "d", 2, 4).collect()}
    assert got == {1: [2.0, 0, 0, 0, 0, 0, 0, 5.0], 2: [0, 0, 0, 0, 0, 0, 7.0, 0]}


def test_table_functions(spark):
    rows = [(log, k, "ab"[k // 3 % 2]) for log in (1, 2) for k in range(8)]
    df = spark.createDataFrame(rows, "log int, at int, topic string").repartition(3)

    def step(state, row):
        out = []
        if state.get("topic") not in (None, row["topic"]):
            out = [(row["log"], state["topic"], state["n"])]
            state["n"] = 0
        state |= {"log": row["log"], "topic": row["topic"], "n": state.get("n", 0) + 1}
        return out

    runs = tables.converter(dict, step, lambda s: [(s["log"], s["topic"], s["n"])] if s else [], "log int, topic string, n int")
    got = sorted(tuple(r) for r in tables.converted(df, ["log"], ["at"], runs).collect())
    assert got == sorted((log, t, n) for log in (1, 2) for t, n in (("a", 3), ("b", 3), ("a", 2)))  # the last run comes from terminate
    spark.udtf.register("runs_of", runs)
    df.createOrReplaceTempView("log_rows")
    assert spark.sql("SELECT count(*) FROM runs_of(TABLE(log_rows) PARTITION BY log ORDER BY at)").first()[0] == 6

    frames = spark.createDataFrame([(k, k // 5, float(k), str(k)) for k in range(10)], "index long, episode int, x double, name string")
    choose = tables.sampler(lambda row: {"x": [row["index"] - 1, row["index"] + 1, None], "name": [row["episode"] * 5] * 2} if row["index"] != 4 else {})
    got = {r["index"]: (r.x, r.name) for r in tables.sampled(frames, frames.select("index", "episode"), ["x", "name"], choose).collect()}
    assert got[0] == ([None, 1.0, None], ["0", "0"]) and got[7] == ([6.0, 8.0, None], ["5", "5"]) and got[4] == ([], []) and len(got) == 10
