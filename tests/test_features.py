import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrail import features
from kinetrail.dataset import TrajectoryDataset
from kinetrail.operators import algebra
from kinetrail.sources import arrow_source


def frames(spark, n=12):
    df = spark.range(n).select(F.col("id").alias("index"), F.floor(F.col("id") / 4).alias("episode_index"), F.floor(F.col("id") / 6).alias("task_index"))
    return df.withColumn("q", F.transform(F.sequence(F.lit(0), F.col("index") % 3), lambda k: F.array(k * 1.0, F.col("index") * 0.5)))


def dataset(spark):
    marked = features.encoded(frames(spark), {"q": features.STEPS})
    return TrajectoryDataset(marked, spark.range(3).withColumnRenamed("id", "episode_index"), spark.range(2).withColumnRenamed("id", "task_index"))


def test_features_are_saved_and_loaded(spark, tmp_path):
    dataset(spark).save(str(tmp_path / "a"))
    back = TrajectoryDataset.load(spark, str(tmp_path / "a"))
    assert features.features_of(back.frames) == {"q": features.STEPS}
    assert features.features_of(back.select_columns(["q"]).rename_columns({"q": "steps"}).frames) == {"steps": features.STEPS}
    plain = features.decoded(back.frames)
    assert plain.exceptAll(frames(spark)).count() == 0 and features.features_of(plain) == {}
    assert sorted(tuple(r.q.shape) for r in back.frames.limit(3).collect()) == [(1, 2), (2, 2), (3, 2)]


def test_tables_that_disagree_are_refused(spark, tmp_path):
    marked, plain = dataset(spark).frames, features.encoded(frames(spark), {"q": features.STEPS})
    assert features.features_of(algebra.concatenated([marked, plain])) == {"q": features.STEPS}
    with pytest.raises(features.FeatureClash, match="in table 1"):
        algebra.concatenated([marked, features.decoded(marked)])
    with pytest.raises(features.FeatureClash, match="another meaning"):
        features.registered(features.Feature("steps", "string"))
    odd = frames(spark).select("index", "episode_index", F.lit("x").alias("q", metadata={"feature": '{"name": "steps", "version": 1, "stored": ""}'}))
    with pytest.raises(features.FeatureClash, match="but feature steps is"):
        features.features_of(odd)
    odd.write.parquet(str(tmp_path / "b/frames"))
    spark.range(3).withColumnRenamed("id", "episode_index").write.parquet(str(tmp_path / "b/episodes"))
    with pytest.raises(features.FeatureClash):
        TrajectoryDataset.load(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="episodes has no episode_index"):
        TrajectoryDataset(frames(spark), spark.range(2)).check()


def test_strays_and_places(spark):
    d = dataset(spark)
    assert d.strays().count() == 0
    less = TrajectoryDataset(d.frames, d.episodes.where("episode_index < 2"), d.tasks)
    assert [tuple(r) for r in less.strays().collect()] == [("episodes", 2, 4)]
    at = lambda which: [r["index"] for r in d.at(which).orderBy("pos").collect()]
    every = list(range(12))
    for s in (slice(None), slice(2, 9, 3), slice(None, None, -1), slice(-5, None), slice(10, 2, -4), slice(50, 60), slice(5, 5)):
        assert at(s) == every[s]
    assert at([3, 3, -1, 0]) == [3, 3, 11, 0] and at(-12) == [0]
    with pytest.raises(IndexError):
        d.at(12)
    assert d.at("task_index").columns == ["index", "task_index"]


def test_arrow_files(spark, tmp_path):
    arrow_source.register(spark)
    rows = frames(spark, 5000).withColumns({"name": F.col("index").cast("string"), "none": F.lit(None).cast("double")})
    at = str(tmp_path / "set")
    for _ in range(2):
        rows.repartition(2).write.format("arrowfile").mode("overwrite").save(at)
    back = spark.read.format("arrowfile").load(at)
    assert back.schema.simpleString() == rows.schema.simpleString() and back.exceptAll(rows).count() == 0 and back.count() == 5000
    some = spark.read.format("arrowfile").schema("name string, index long").load(at)
    assert some.columns == ["name", "index"] and some.where("name != cast(index as string)").count() == 0
    table = pa.table({"a": list(range(100)), "b": [str(k) for k in range(100)]})
    with pa.OSFile(str(tmp_path / "one.arrow"), "wb") as out, pa.ipc.new_file(out, table.schema) as file:
        file.write_table(table, max_chunksize=10)
    with pa.OSFile(str(tmp_path / "two.arrow"), "wb") as out, pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table, max_chunksize=10)
    parts = arrow_source.ArrowReader({"path": str(tmp_path / "one.arrow"), "batches": "4"}, None).partitions()
    assert [(p.begin, p.end) for p in parts] == [(0, 4), (4, 8), (8, 10)]
    for name, many in (("one", 3), ("two", 1)):
        df = spark.read.format("arrowfile").option("batches", 4).load(str(tmp_path / f"{name}.arrow"))
        assert sorted((r.a, r.b) for r in df.collect()) == [(k, str(k)) for k in range(100)] and df.rdd.getNumPartitions() == many
    with pytest.raises(Exception, match="has no column"):
        spark.read.format("arrowfile").schema("c long").load(str(tmp_path / "one.arrow")).count()
