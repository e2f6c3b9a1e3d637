import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.dataset import TrajectoryDataset
from kinetrail.operators import assembly


def test_cameras_of_frames(spark):
    frames = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0)], "rec string, step int")
    eye = [float(k in (0, 5, 10)) for k in range(12)]
    cameras = spark.createDataFrame([("a", "top", [2.0] * 9, eye), ("a", "hand", [3.0] * 16, None), ("b", "top", [4.0] * 9, [float(k) for k in range(16)])], "rec string, camera string, intrinsic array<double>, world_to_camera array<double>")
    moving = spark.createDataFrame([("a", "hand", 1, [7.0] * 12)], "rec string, camera string, step int, world_to_camera array<double>")
    got = {(r.rec, r.step): r.cameras for r in assembly.camera_rows(frames, cameras, moving, "rec", "step").collect()}
    assert [c.camera for c in got["a", 1]] == ["hand", "top"] and got["c", 0] is None
    assert got["a", 1][0].world_to_camera == [7.0] * 12 + [0, 0, 0, 1] and got["a", 0][0].world_to_camera is None
    assert got["a", 0][1].world_to_camera == [*eye, 0, 0, 0, 1] and got["a", 0][0].intrinsic == [3.0, 3, 3, 0, 3, 3, 3, 0, 3, 3, 3, 0, 0, 0, 0, 1]
    assert got["b", 0][0].world_to_camera == [float(k) for k in range(12)] + [0, 0, 0, 1] and got["b", 0][0].intrinsic[:4] == [4.0, 4, 4, 0]
    some = assembly.camera_rows(frames, cameras, moving, "rec", "step", ["top", "hand"]).where("rec = 'a'").first()
    assert [c.camera for c in some.cameras] == ["top", "hand"]


def test_datasets_as_one(spark):
    def made(sizes, base):
        rows = [(k, e, base + k) for k, e in enumerate(e for e, n in enumerate(sizes) for _ in range(n))]
        return TrajectoryDataset(spark.createDataFrame(rows, "index long, episode_index long, x long"), spark.range(len(sizes)).withColumnRenamed("id", "episode_index"))

    frames, episodes = assembly.composed([made([3, 2], 0), made([4], 100)], lambda f: f.withColumn("y", F.col("x").getItem(0) if "array" in dict(f.dtypes)["x"] else F.col("x")), {"x": [0, 1]})
    assert sorted((r["index"], r.dataset_index, r.y, tuple(r.x)) for r in frames.collect()) == [(0, 0, 0, (0, 1)), (1, 0, 1, (1, 2)), (2, 0, 2, (2, None)), (3, 0, 3, (3, 4)), (4, 0, 4, (4, None)), *[(5 + k, 1, 100 + k, (100 + k, 101 + k if k < 3 else None)) for k in range(4)]]
    assert sorted((r.dataset, r.episode_index, r.episode, r.start, r.end) for r in episodes.collect()) == [(0, 0, 0, 0, 3), (0, 1, 1, 3, 5), (1, 0, 2, 5, 9)]


CAMERA = "struct<frame_id: string, intrinsic: array<double>, pose: struct<parent: string, child: string, matrix: array<double>>, height: int, width: int>"
ROW = f"frame_index long, joints array<array<float>>, actions array<array<float>>, instruction string, info string, top {CAMERA}, hand {CAMERA}, hand_depth array<int>"


def test_rows_parsed_for_training(spark):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = turn, rng.normal(size=3)
    k = rng.normal(size=9).tolist()
    top = ("lens", k, ("world", "lens", pose.ravel().tolist()), 2, 3)
    hand = ("lens2", k, ("world", "hand", np.eye(4).ravel().tolist()), 2, 3)
    rows = [
        (4, [[1.0, 2.0], [3.0, 4.0]], [[5.0]], '{"description": "pick"}', '{"uuid": "a1"}', top, hand, [500, 0, 0, 0, 0, 1000]),
        (5, None, [], "broken", None, top, None, None),
        (6, [], [], "{}", "{}", (*top[:2], None, 2, 3), hand, None),
    ]
    got = assembly.parsed_rows(spark.createDataFrame(rows, ROW), ["top", "hand"], 2).collect()
    a, b, c = got
    assert (a.joint_state, a.master_joint_state, a.text, a.uuid, a.step_index, a.step_index_in_chunk) == ([[1.0, 2.0], [3.0, 4.0]], [[5.0]], "pick", "a1", 4, 1)
    assert np.allclose(np.reshape(a.world_to_camera[0], (4, 4)), np.linalg.inv(pose)) and np.allclose(np.reshape(a.world_to_camera[1], (4, 4)), np.eye(4))
    assert np.allclose(np.reshape(a.intrinsic[0], (4, 4))[:3, :3], np.reshape(k, (3, 3))) and a.intrinsic[0][15] == 1.0
    assert a.depths == [[0.0] * 6, [0.5, 0, 0, 0, 0, 1.0]]
    assert (b.joint_state, b.master_joint_state, b.text, b.uuid, b.intrinsic[1], b.world_to_camera[1], b.depths) == (None, [], None, None, None, None, [[0.0] * 6] * 2)
    assert (c.text, c.uuid, c.world_to_camera[0]) == (None, None, None)


@pytest.mark.parametrize("pose", [("map", "lens"), ("world", "other"), (None, "lens"), ("world", None)])
def test_poses_of_other_frames_are_refused(spark, pose):
    top = ("lens", [1.0] * 9, (*pose, [1.0] * 16), 1, 1)
    with pytest.raises(Exception, match="pose of top goes from"):
        assembly.parsed_rows(spark.createDataFrame([(0, [], [], None, None, top, None, None)], ROW), ["top"]).collect()


def test_boxes_of_evenly_spaced_views(spark):
    rng = random.Random(3)
    scenes = []
    for s, n in ((1, 10), (2, 3), (3, 0)):
        boxes = [[0.0, 0.0, rng.uniform(-1, 4), 1.0, 1.0, 1.0] for _ in range(5)]
        scenes.append((s, [([rng.randrange(5) for _ in range(rng.randrange(4))], [float(k)] * 16) for k in range(n)], boxes))
    df = spark.createDataFrame(scenes, "scene int, images array<struct<visible: array<int>, world_to_view: array<double>>>, boxes array<array<double>>")
    got = sorted((r.scene, r.view, tuple(r.box)) for r in assembly.view_boxes(df, "scene", "images", "boxes", 4, -0.2, 3.0).collect())
    want = []
    for s, images, boxes in scenes:
        n = len(images)
        rest = 4 % n if n else 0
        for k in (list(range(n)) * (4 // n) + [i * n // rest for i in range(rest)] if n else []):
            want += [(s, k, tuple(boxes[i])) for i in images[k][0] if -0.2 < boxes[i][2] < 3]
    assert got == sorted(want) and got


def test_flags_of_texts(spark):
    rows = [("the chair left of it", ["1"]), ("the lefty chair", []), (None, None), ("looking at\tit", list("12345"))]
    got = [tuple(r)[2:] for r in assembly.grounding_flags(spark.createDataFrame(rows, "text string, distractor_ids array<string>")).collect()]
    assert got == [(False, False, True), (True, False, False), (None, None, None), (False, True, True)]


def test_clusters_of_boxes(spark):
    from kinetrail.operators import metrics

    rng = random.Random(8)
    middles = [(0.0, 0.0, 1.0), (50.0, 0.0, 2.0), (0.0, 80.0, 3.0)]
    rows = [([m + rng.uniform(-1, 1) for m in middles[k % 3]],) for k in range(300)]
    got = sorted(metrics.clusters(spark.createDataFrame(rows, "box array<double>"), "box", 3, 1).collect(), key=lambda r: [round(c) for c in r.centre])
    for r, k in zip(got, (0, 2, 1), strict=True):
        held = [b for (b,) in rows[k::3]]
        assert r.n == 100 and all(abs(c - sum(b[i] for b in held) / 100) < 1e-6 for i, c in enumerate(r.centre))


def test_a_rewritten_table_is_packaged_anew(spark, tmp_path):
    from kinetrail.plans import registry

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in (10, 25):
        events.orderBy("event_id").limit(n).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
        assert registry.frames_of(spark, str(tmp_path)).count() == n
        assert registry.dataset(spark, str(tmp_path))["frames"].inputFiles() == registry.dataset(spark, str(tmp_path))["frames"].inputFiles()
