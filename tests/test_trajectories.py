import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kinetrail.dataset import TrajectoryDataset
from kinetrail.operators import algebra, messages, sharding, temporal
from kinetrail.operators.messages import Monitor
from kinetrail.sources import store
from kinetrail.streaming import batching
from kinetrail.tables import positions


def frames(spark, episodes, step=10**9):
    rows, at = [], {}
    for i, e in enumerate(episodes):
        k = at.get(e, 0)
        at[e] = k + 1
        rows.append((i, e, k, k * step, k * step, f"v{i}"))
    return spark.createDataFrame(rows, "index long, episode_index long, frame_index long, timestamp_min long, timestamp_max long, data string")


def lists(df, column):
    return [r[column] for r in df.orderBy("index").collect()]


def test_offsets_stop_at_episodes(spark):
    got = temporal.offset_window(frames(spark, [0, 0, 0, 1, 1, 1, 2, 2]), {"data": [-1, 0, 1, None]})
    assert lists(got, "data")[:4] == [[None, "v0", "v1", None], ["v0", "v1", "v2", None], ["v1", "v2", None, None], [None, "v3", "v4", None]]


def test_deltas_at_25_frames_a_second(spark):
    f = frames(spark, [0] * 5 + [1] * 5, 40_000_000)
    got = lists(temporal.delta_window(f, {"data": [0, 0.05001]}, 0.01), "data")
    assert got == [[f"v{i}", None] for i in range(10)]
    got = lists(temporal.delta_window(f, {"data": [-0.04, 0.04]}, 0.01), "data")
    assert got[0] == [None, "v1"] and got[4] == ["v3", None] and got[5] == [None, "v6"]


def test_interval_join_of_touching_frames(spark):
    rows = [(0, 0, 1, 2, "a"), (1, 0, 3, 3, "b"), (2, 0, 3, 4, "c"), (3, 1, 3, 3, "d")]
    f = spark.createDataFrame(rows, "index long, episode_index long, timestamp_min long, timestamp_max long, data string")
    for width in (1, 2, 100):
        assert lists(temporal.delta_join(f, "data", 1e-9, 0, width), "data") == ["a", "c", "c", None]  # touching counts, so the first frame meets its own range


@pytest.mark.parametrize("hist,pred,stride", [(1, 3, 1), (3, 2, 3), (4, 0, 1), (2, 20, 2)])
def test_chunks_repeat_the_edges(spark, hist, pred, stride):
    episodes = [0] * 10 + [1] * 10
    got = lists(temporal.chunk(frames(spark, episodes), ["index"], hist, pred, stride).withColumn("at", F.col("index")).withColumn("index", F.get("at", F.lit(hist - 1))), "at")
    for i, chunk in enumerate(got):
        low, high = i // 10 * 10, i // 10 * 10 + 9
        assert chunk == [min(max(x, low), high) for x in [*range(i - hist + 1, i + 1), *(i + k * stride for k in range(1, pred + 1))]]


def test_nearest_prefers_the_earlier(spark):
    base = spark.createDataFrame([(0, 10), (0, 20), (1, 5)], "e int, log_time long")
    stream = spark.createDataFrame([(0, 8, "a"), (0, 12, "b"), (0, 20, "c"), (0, 21, "d")], "e int, log_time long, m string")
    got = {(r.e, r.log_time): (r.m, r.apart) for r in temporal.nearest(base, stream, "m", ["e"]).collect()}
    assert got == {(0, 10): ("a", 2), (0, 20): ("c", 0), (1, 5): (None, None)}


@pytest.mark.parametrize("n,shards", [(10, 3), (5, 2), (2, 5), (9, 3)])
def test_shards(spark, n, shards):
    df = positions(spark.createDataFrame([(v,) for v in range(1, n + 1)], "v int"), ["v"])
    cut = sharding.sharded(df, shards).groupBy("shard").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()
    small, big = divmod(n, shards)
    want, at = [], 1
    for k in range(shards):
        size = small + (k < big)
        want.append(list(range(at, at + size)))
        at += size
    assert sorted(r.v for r in cut) == sorted(w for w in want if w)
    padded = sharding.sharded(df, shards, True, "pad_last").groupBy("shard").count().collect()
    assert {r["count"] for r in padded} == {-(-n // shards)} and len(padded) == shards


def test_positions_over_hot_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 5]), rng.randrange(10**6), rng.randrange(9)) for _ in range(3000)]
    got = positions(spark.createDataFrame(rows, "a int, b int, w long"), ["a", "b", "w"], "pos", "w").orderBy("pos").collect()
    assert [(r.a, r.b, r.w) for r in got] == sorted(rows) and [r.pos for r in got] == list(range(3000))
    total = 0
    for r in got:
        assert r.begin == total
        total += r.w


def test_merge_rejects_late_links_and_unknown_keys(spark):
    schema = "episode_index long, frame_num long, dataset_begin_index long, prev_episode_index long"
    good, bad = spark.createDataFrame([(0, 2, 0, None), (1, 3, -1, 0)], schema), spark.createDataFrame([(0, 2, 0, 1), (1, 3, 2, None)], schema)
    merged = algebra.merged_episodes([good, good])[0].orderBy("episode_index").collect()
    assert [(r.episode_index, r.dataset_begin_index, r.prev_episode_index) for r in merged] == [(0, 0, None), (1, -1, 0), (2, 5, None), (3, -1, 2)]
    with pytest.raises(Exception, match="earlier"):
        algebra.merged_episodes([bad])[0].collect()
    one = spark.createDataFrame([(0, 9)], "dataset_index int, task_index long")
    with pytest.raises(Exception, match="no mapping"):
        algebra.remapped(one, "task_index", spark.createDataFrame([(0, 1, 1)], "dataset_index int, old long, new long")).collect()


def log_of(rng, n):
    return [(k // 60, rng.choice("abc"), k * 10**8, str(k)) for k in range(n)]


@pytest.mark.parametrize("least,most,ahead", [(3, 3, 0), (3, 4, 10**9), (3, 30, 10**9)])
def test_batches_hold_least_to_most(spark, least, most, ahead):
    rows = log_of(random.Random(2), 240)
    df = spark.createDataFrame(rows, "log long, topic string, log_time long, data string")
    got = messages.batched(df, (Monitor("a", least, most, ahead),), "log", ["log_time", "data"]).orderBy("log_time").collect()
    count = {}
    for r in got:
        count[r.log, r.batch] = count.get((r.log, r.batch), 0) + (r.topic == "a")
    last = {}
    for log, batch in count:
        last[log] = max(batch, last.get(log, 0))
    assert all(least <= n <= most for (log, batch), n in count.items() if batch != last[log])


def test_streamed_batches_equal_the_batch_ones(spark, tmp_path):
    rows = log_of(random.Random(3), 180)
    monitors = (Monitor("a", 2, 3, 10**9), Monitor("b", 2, 5, 0))
    source, schema = tmp_path / "in", "log long, topic string, log_time long, data string"
    source.mkdir()
    for k in range(0, 180, 30):
        (source / f"{k:04}.json").write_text("\n".join(json.dumps(dict(zip(("log", "topic", "log_time", "data"), r, strict=True))) for r in rows[k : k + 30]))
        os.utime(source / f"{k:04}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files arrive in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    run = batching.batched_stream(stream, monitors).writeStream.format("memory").queryName("placed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = messages.batched(spark.createDataFrame(rows, schema), monitors, "log", ["log_time", "topic", "data"], False)
    assert sorted((r.data, r.batch) for r in spark.table("placed").collect()) == sorted((r.data, r.batch) for r in want.collect())


def test_save_load_and_publish(spark, tmp_path):
    raw = spark.createDataFrame([(u, t, "run" if u % 2 else "walk") for u in (7, 3, 5) for t in range(4)], "user long, t long, name string")
    parts = store.packaged(raw, ["user"], ["t"], {"task": ["name"]})
    path = str(tmp_path / "set")
    made = TrajectoryDataset(parts["frames"], parts["episodes"], parts["tasks"])
    made.save(path)
    with pytest.raises(FileExistsError):
        made.save(path)
    made.save(path, replace_existing=True)
    back = TrajectoryDataset.load(spark, path)
    assert back.counts() == {"frames": 12, "episodes": 3, "tasks": 1}
    assert [r["index"] for r in back.rows()] == list(range(12)) and back.row(4).user == 5
    assert {r.task.name for r in back.with_metadata().collect()} == {"run"}
    kept = back.filter(episode=F.col("user") > 3, row=F.col("t") < 2)
    assert kept.frames.count() == 4
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    with pytest.raises(ValueError):
        back.rename_columns({"t": "index"})


def test_flat_tables_and_messages(spark):
    rows = spark.createDataFrame([(0, k, k * 2.0) for k in range(5)], "episode_index long, frame_index long, x double")
    got = store.flat_robot_table(rows, 25, 3)
    assert [r.timestamp_min for r in got.orderBy("frame_index").collect()] == [0, 40_000_000, 80_000_000]
    assert store.episode_messages(got, {"x": "/x"}).count() == 3
