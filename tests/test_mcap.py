import random

import pytest

from kinetrail.sources import mcap


@pytest.mark.parametrize("compression,summary", [("", True), ("zstd", True), ("zstd", False), ("lz4", True)])
def test_written_files_come_back(spark, tmp_path, compression, summary):
    rng = random.Random(1)
    logs = {f"{k}.mcap": [(rng.choice("abc"), 10 * i, str(rng.random()).encode()) for i in range(2500)] for k in range(3)}
    for name, rows in logs.items():
        (tmp_path / name).write_bytes(mcap.packed(rows, compression=compression, summary=summary))
    (tmp_path / "other.txt").write_text("no log")
    got = mcap.read(spark, str(tmp_path)).collect()
    assert sorted((r.path.rpartition("/")[2], r.topic, r.log_time, bytes(r.data)) for r in got) == sorted((n, *m) for n, rows in logs.items() for m in rows)
    assert {r.encoding for r in got} == {"json"}
    some = mcap.read(spark, str(tmp_path), ["a", "c"], 9_000, 21_000).collect()
    assert sorted((r.topic, r.log_time) for r in some) == sorted((t, n) for rows in logs.values() for t, n, _ in rows if t in "ac" and 9_000 <= n < 21_000)


def test_empty_and_broken_files():
    assert list(mcap.parsed(mcap.packed([]))) == []
    with pytest.raises(ValueError, match="not an MCAP"):
        list(mcap.parsed(b"something else"))


def test_an_index_lets_the_source_skip_chunks(spark, tmp_path):
    from kinetrail.sources import mcap_source

    mcap_source.register(spark)
    logs = {}
    for k in range(2):  # topic "rare" only in every tenth chunk
        logs[f"{k}.mcap"] = [("rare" if i // 50 % 10 == 3 and i % 50 == 0 else "ab"[i % 2], 10 * i, b"x" * (i % 7)) for i in range(5000)]
        (tmp_path / f"{k}.mcap").write_bytes(mcap.packed(logs[f"{k}.mcap"], chunk=50))
    (tmp_path / "plain.mcap").write_bytes(mcap.packed([("a", 7, b"seven")], summary=False))
    every = spark.read.format("mcap").load(str(tmp_path))
    want = sorted((n, *m) for n, rows in logs.items() for m in rows) + [("plain.mcap", "a", 7, b"seven")]
    assert sorted((r.path.rpartition("/")[2], r.topic, r.log_time, bytes(r.data)) for r in every.collect()) == sorted(want)

    def planned(*filters, **options):
        reader = mcap_source.McapReader({"path": str(tmp_path), **options}, every.schema)
        left = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        return left, parts, sum(len(p.chunks or [0]) for p in parts)

    from pyspark.sql import datasource as ds

    assert planned()[2] == 201 and len(planned()[1]) == 3
    assert len(planned(partitionBytes="1000")[1]) > 40  # a long log is many tasks
    assert planned(ds.EqualTo(("topic",), "rare"))[2] == 21
    other = ds.EqualTo(("sequence",), 3)
    left, parts, chunks = planned(ds.In(("topic",), ("rare", "none")), ds.GreaterThan(("log_time",), 20_000), ds.LessThanOrEqual(("log_time",), 36_500), ds.IsNotNull(("topic",)), other)
    assert left == [other] and chunks == 2 * 4 + 1  # the file without an index is one whole part
    some = every.where("topic = 'rare' and log_time > 20000 and log_time <= 36500 and length(data) >= 0")
    assert sorted(r.log_time for r in some.collect()) == sorted(t for rows in logs.values() for n, t, _ in rows if n == "rare" and 20_000 < t <= 36_500)
    one = spark.read.format("mcap").option("offset", 1000).option("duration", 500).load(str(tmp_path / "0.mcap"))
    assert sorted(r.log_time for r in one.collect()) == list(range(1000, 1500, 10))
    with pytest.raises(Exception, match="no index"):
        spark.read.format("mcap").option("offset", 1).load(str(tmp_path / "plain.mcap")).count()


def test_only_wanted_chunks_are_opened(spark, tmp_path, monkeypatch):
    from pyspark.sql import datasource as ds

    from kinetrail.sources import mcap_source

    (tmp_path / "a.mcap").write_bytes(mcap.packed([("ab"[i // 500 % 2], i, b"d") for i in range(4000)], chunk=100))
    opened = []
    plain = mcap._unpacked
    monkeypatch.setattr(mcap, "_unpacked", lambda *a: opened.append(1) or plain(*a))
    reader = mcap_source.McapReader({"path": str(tmp_path)}, None)
    assert list(reader.pushFilters([ds.EqualTo(("topic",), "b"), ds.LessThan(("log_time",), 1200)])) == []
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["log_time"] for r in rows] == list(range(500, 1000)) and len(opened) == 5


def test_written_by_tasks_and_read_again(spark, tmp_path):
    from pyspark.sql import functions as F

    from kinetrail.sources import mcap_source

    mcap_source.register(spark)
    rows = spark.range(0, 5000, 1, 3).select(F.concat(F.lit("/t"), F.col("id") % 3).alias("topic"), (F.col("id") * 5).alias("log_time"), F.col("id").cast("string").cast("binary").alias("data"))
    at = str(tmp_path / "logs")
    for _ in range(2):
        rows.write.format("mcap").mode("overwrite").option("chunk", 100).save(at)
    got = spark.read.format("mcap").load(at)
    assert got.select("topic", "log_time", "data").exceptAll(rows).count() == 0 and got.count() == 5000
    assert got.select("path").distinct().count() == 3 and not list((tmp_path / "logs").glob("_staged*"))
    rows.limit(10).write.format("mcap").mode("append").save(at)
    assert spark.read.format("mcap").load(at).count() == 5010
    assert len(list(mcap.parsed(next((tmp_path / "logs").glob("*.mcap")).read_bytes()))) > 0
    with pytest.raises(Exception, match="needs the columns"):
        rows.drop("data").write.format("mcap").mode("append").save(at)
