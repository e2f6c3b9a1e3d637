import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import sharding
from kinetrail.sources import store

FRAMES = "robot string, at long, text string, timestamp_min long, timestamp_max long"


def frames(spark):
    rows = [("a", k, str(k), k, k + 1) for k in range(5)]
    rows += [("b", 0, "0", 0, 1), ("b", 1, "x", 1, 2), ("b", 2, "2", 2, 3), ("b", 3, "y", 3, 3)]
    rows += [("c", 0, "z", 0, 0), ("d", 0, "0", 3, 2), (None, 0, "5", 1, 1), (None, 1, "6", None, 1), ("bad meta", 0, "1", 0, 0), ("e", 9, "9", 9, 9)]
    return spark.createDataFrame(rows, FRAMES)


def failure():
    number = F.when(F.try_to_number("text", F.lit("9")).isNull(), F.concat(F.lit("not a number: "), "text"))
    return F.coalesce(number, store.unordered_times())


def test_frames_before_a_failure_stay(spark, tmp_path):
    skip = F.when(F.first("robot") == "bad meta", F.lit("no such robot"))
    parts = store.packaged_with_failures(frames(spark), ["robot"], ["at"], failure(), skip)
    got = store.saved_together(parts, str(tmp_path / "set"))
    assert sorted((r.robot or "", r.kind, r.reason, r["at"] and r["at"]["at"], r.kept, r.lost) for r in got["quarantine"].collect()) == [
        ("", "frame", "a frame must have both times", 1, 1, 1),
        ("b", "frame", "not a number: x", 1, 1, 3),
        ("bad meta", "episode", "no such robot", None, 0, 1),
        ("c", "frame", "not a number: z", 0, 0, 1),
        ("d", "frame", "a frame must not end before it begins", 0, 0, 1),
    ]
    episodes = {r.robot: (r.episode_index, r.frame_num, r.dataset_begin_index) for r in got["episodes"].collect()}
    assert episodes == {None: (0, 1, 0), "a": (1, 5, 1), "b": (2, 1, 6), "c": (3, 0, 7), "d": (4, 0, 7), "e": (5, 1, 7)}
    kept = sorted((r["index"], r.robot, r.frame_index) for r in got["frames"].collect())
    assert kept == [(0, None, 0), *[(k + 1, "a", k) for k in range(5)], (6, "b", 0), (7, "e", 0)]
    with pytest.raises(store.FailedEpisode, match="a frame must have both times"):
        store.packaged_with_failures(frames(spark), ["robot"], ["at"], failure(), skip, fail_fast=True)
    assert store.packaged_with_failures(frames(spark).where("robot = 'a'"), ["robot"], ["at"], failure(), fail_fast=True)["quarantine"].count() == 0


def test_tables_are_published_together(spark, tmp_path):
    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("x"))
    with pytest.raises(Exception, match="stop"):
        store.saved_together({"one": good, "two": bad}, str(tmp_path / "set"))
    assert not (tmp_path / "set").exists() and not list(tmp_path.iterdir())


def mixed(spark, sizes, active, seed):
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    random.Random(1).shuffle(rows)
    got = sharding.active_mix(spark.createDataFrame(rows, "source string, id long"), "source", ["id"], active, seed).orderBy("mix_pos").collect()
    assert [r.mix_pos for r in got] == list(range(len(rows))) and Counter(r.source for r in got) == Counter(sizes)
    return [(r.source, r.id) for r in got]


SIZES = {"a": 40, "b": 10, "c": 25, "d": 1, "e": 60}


def test_one_open_source_follows_another(spark):
    assert mixed(spark, SIZES, 1, None) == [(s, k) for s, n in SIZES.items() for k in range(n)]
    got = mixed(spark, SIZES, 1, 7)
    assert len([1 for (a, _), (b, _) in zip(got, got[1:], strict=False) if a != b]) == 4


@pytest.mark.parametrize("active", [1, 2, 3, 5, 9])
def test_no_more_sources_than_allowed_are_open(spark, active):
    for seed in (None, 3):
        got = mixed(spark, SIZES, active, seed)
        assert got == mixed(spark, SIZES, active, seed)
        first, last = {}, {}
        for at, (s, _) in enumerate(got):
            first.setdefault(s, at)
            last[s] = at
        assert max(sum(first[s] <= at <= last[s] for s in SIZES) for at in range(len(got))) <= active
        if seed is None:
            assert all([k for s, k in got if s == one] == list(range(n)) for one, n in SIZES.items())


def test_draws_have_the_weights_of_the_open_sources(spark):
    """Until one of two sources ends, draws are of it with its share, and independent, as a generator's choices."""
    sizes = {"a": 3000, "b": 1000}
    got = [s for s, _ in mixed(spark, sizes, 2, 11)][:3000]
    share = np.mean([s == "a" for s in got])
    assert abs(share - 0.75) < 0.03
    after_b = np.mean([b == "a" for a, b in zip(got, got[1:], strict=False) if a == "b"])
    assert abs(after_b - 0.75) < 0.05


def test_even_draws_against_a_walk(spark):
    for active in (1, 2, 5):
        slots, starts = [0.0] * active, {}
        for s, n in SIZES.items():
            start = min(slots)
            slots[slots.index(start)] = start + (n + 1) / n
            starts[s] = start
        want = sorted((starts[s] + (k + 1) / n, i, s, k) for i, (s, n) in enumerate(SIZES.items()) for k in range(n))
        assert mixed(spark, SIZES, active, None) == [(s, k) for _, _, s, k in want]
    with pytest.raises(ValueError, match="at least one"):
        mixed(spark, SIZES, 0, None)


def test_shards_by_bytes(spark, tmp_path):
    import pyarrow.parquet as pq

    from kinetrail.dataset import TrajectoryDataset

    rng = random.Random(5)
    sizes = [rng.randrange(10, 300) for _ in range(300)] + [5000] + [20] * 50
    frames = spark.createDataFrame([(k, 0, "x" * n) for k, n in enumerate(sizes)], "index long, episode_index long, data string")
    cut = sharding.byte_shards(frames, 1000, ["index"]).orderBy("index").collect()
    assert [r.bytes for r in cut] == [n + 16 for n in sizes] and [r.shard for r in cut] == sorted(r.shard for r in cut)
    for shard in {r.shard for r in cut}:
        held = [r.bytes for r in cut if r.shard == shard]
        assert sum(held) <= 1000 or (held[-1] > 500 and sum(held[:-1]) <= 1000)
    TrajectoryDataset(frames, spark.createDataFrame([(0,)], "episode_index long")).save(str(tmp_path / "set"), max_shard_bytes=1000)
    files = [pq.read_table(f).to_pylist() for f in (tmp_path / "set" / "frames").glob("*.parquet")]
    held = sorted(([r["index"] for r in f] for f in files if f))
    assert [i for f in held for i in f] == list(range(351)) and len(held) == len({r.shard for r in cut})
    assert TrajectoryDataset.load(spark, str(tmp_path / "set")).frames.columns == ["index", "episode_index", "data"]
    nested = spark.createDataFrame([("ab", [1, 2, 3], ["x", "yz"], {"k": "vv"}, (1, "é"), None)], "a string, b array<int>, c array<string>, d map<string, string>, e struct<x: int, y: string>, f string")
    assert nested.select(sharding.row_bytes(nested)).first()[0] == 2 + 24 + 3 + 3 + 10 + 0


def test_positions_of_one_huge_part_and_many_small_ones(spark):
    from kinetrail.operators import lookups

    parts = [(k, 1 + k % 3 if k != 700 else 1_000_000) for k in range(2000)] + [(2001, 0)]
    starts, at = [], 0
    for part, size in parts:
        starts.append((at, part, size))
        at += size
    rng = random.Random(4)
    asked = [rng.randrange(at) for _ in range(300)] + [rng.randrange(2000) for _ in range(200)] + [-1, -5, at - 1, at, 0]
    want = []
    for pos in asked:
        real = pos + at if pos < 0 else pos
        want += [(pos, part, real - start) for start, part, size in starts if start <= real < start + size]
    df = spark.createDataFrame([(p,) for p in asked], "pos long")
    got = lookups.routed(df, spark.createDataFrame(parts, "part long, size long"))
    assert sorted((r.pos, r.part, r.local) for r in got.collect()) == sorted(want)
