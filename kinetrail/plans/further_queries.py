"""Queries of counts, limits, statistics, imports and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.functions import scalars
from kinetrail.operators import filters, messages, metrics, sharding
from kinetrail.plans.registry import dataset, frames_of, nanoseconds_of, query, rounded
from kinetrail.schema import valid_times
from kinetrail.sources.store import episode_messages, flat_robot_table, job_slice
from kinetrail.tables import positions, read


@query("SELECT count(DISTINCT user_id) AS episodes, count(*) AS n_frames, count(DISTINCT event_type) AS tasks FROM events")
def g1_counts(spark, sf_dir):
    parts = dataset(spark, sf_dir)
    f = parts["frames"].agg(F.count("*").alias("n_frames"), F.countDistinct("event_type").alias("tasks"))
    return parts["episodes"].agg(F.count("*").alias("episodes")).crossJoin(f)  # one row each


@query("SELECT event_type AS task, count(DISTINCT user_id) AS episodes, count(*) AS steps FROM events GROUP BY 1")
def g2_task_statistics(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.countDistinct("user_id").alias("episodes"), F.count("*").alias("steps"))


@query("""SELECT episode_index, CAST(sum(count(*)) OVER (ORDER BY episode_index) AS BIGINT) AS running FROM frames GROUP BY 1""")
def w14_cumulative_sizes(spark, sf_dir):
    return dataset(spark, sf_dir)["episodes"].select("episode_index", (F.col("dataset_begin_index") + F.col("frame_num")).cast("long").alias("running"))


@query("""SELECT "index" FROM frames WHERE frame_index < 20""")
def l16_cap_frames(spark, sf_dir):
    return frames_of(spark, sf_dir).where("frame_index < 20").select("index")


@query("""SELECT "index" FROM frames WHERE frame_index % 4 = 0""")
def l17_stride(spark, sf_dir):
    return frames_of(spark, sf_dir).where("frame_index % 4 = 0").select("index")


@query("""SELECT event_id, value <= 20 AND value + 5 >= 10 AS meets, round(greatest(least(value + 5, 20) - greatest(value, 10), 0) / (15 - greatest(least(value + 5, 20) - greatest(value, 10), 0)), 6) AS iou FROM events""")
def f4_interval_overlap(spark, sf_dir):
    a, b, lo, hi = F.col("value"), F.col("value") + 5, F.lit(10.0), F.lit(20.0)
    return read(spark, sf_dir, "events").select("event_id", filters.overlaps(a, b, lo, hi).alias("meets"), F.round(filters.interval_iou(a, b, lo, hi), 6).alias("iou"))


@query("""SELECT vec_id, bool_and(x > -0.25 AND x < 0.25) AS within, round(sum(greatest(-0.1, least(0.1, x))), 6) AS clipped_sum
FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1""")
def f8_joint_limits(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    total = F.aggregate(filters.clipped(e, 0.1), F.lit(0.0), lambda s, x: s + x)
    return read(spark, sf_dir, "embeddings").select("vec_id", filters.within_limits(e, 0.25).alias("within"), F.round(total, 6).alias("clipped_sum"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 20000 AND o_totalprice <= 150000 AND o_custkey <= 900")
def f9_workspace_box(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(filters.in_box({"o_totalprice": (20000, 150000), "o_custkey": (None, 900)})).select("o_orderkey")


@query("""SELECT count(*) AS n FROM frames WHERE timestamp_max - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END >= timestamp_min""")
def f13_valid_times(spark, sf_dir):
    late = F.when(F.col("event_id") % 3 == 0, F.col("timestamp_max") - 1).otherwise(F.col("timestamp_max"))
    return frames_of(spark, sf_dir).withColumn("timestamp_max", late).where(valid_times()).agg(F.count("*").alias("n"))


@query("""SELECT k - 1 AS joint, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max
FROM (SELECT k, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(k)) GROUP BY 1""")
def g19_moments(spark, sf_dir):
    return metrics.moments(read(spark, sf_dir, "embeddings"), "embedding").select(F.col("joint").cast("long").alias("joint"), *rounded("mean", "std", "min", "max"))


@query("""WITH g AS (SELECT l_suppkey % 30 AS scene, l_tax * 10 AS score, row_number() OVER (PARTITION BY l_suppkey % 30 ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem),
a AS (SELECT scene, f, k, sum(CASE WHEN score > 0 AND score <= f THEN 1 ELSE 0 END) / k AS accuracy FROM g, (SELECT unnest([0.2, 0.4, 0.8]) AS f), range(1, 21) t(k) WHERE r <= k GROUP BY 1, 2, 3)
SELECT CASE WHEN scene < 10 THEN 'seen' WHEN scene < 20 THEN 'similar' ELSE 'novel' END AS part, round(avg(accuracy), 6) AS ap FROM a GROUP BY 1""")
def g12_grasp_ap(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    g = rows.select((F.col("l_suppkey") % 30).alias("scene"), (F.col("l_tax") * 10).alias("score"), F.col("l_extendedprice").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("grasp_id"))
    part = F.when(F.col("scene") < 10, "seen").when(F.col("scene") < 20, "similar").otherwise("novel")
    return metrics.grasp_accuracy(g, ["scene"], [0.2, 0.4, 0.8]).groupBy(part.alias("part")).agg(F.round(F.avg("accuracy"), 6).alias("ap"))


@query("SELECT round(avg(v), 6) AS value FROM (SELECT user_id, min(value) AS v FROM events WHERE event_id % 5 < 3 GROUP BY 1)")
def g13_best_of_modes(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).alias("mode"), "value")
    return metrics.best_of(rows, ["user_id"], "mode", ["value"], 3).select(*rounded("value"))


@query("SELECT p_partkey, greatest(1, CAST(round_even(p_size * 0.25, 0) AS BIGINT)) AS small FROM part")
def c29_downscaled_size(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalars.downscaled(F.col("p_size"), 0.25).alias("small"))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def c30_base64_json(spark, sf_dir):
    there = scalars.to_base64_json(F.struct(F.col("o_orderstatus").alias("status")))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.from_base64_json(there, "status string")["status"].alias("status"))


@query("SELECT vec_id, round((e[5] + e[6] + e[7]) / 3, 6) AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def c36_phrase_score(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.phrase_score(e, F.lit(4), F.lit(7)), 6).alias("score"))


@query("SELECT g, conv_id, max(n) OVER (PARTITION BY g) - n AS zeros, n FROM (SELECT conv_id, conv_id % 7 AS g, count(*) AS n FROM conversations GROUP BY 1)")
def l19_collate(spark, sf_dir):
    """Arrays of as many ones as a conversation has turns, padded to the longest of their batch."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("c"))
    rows = turns.select((F.col("conv_id") % 7).alias("g"), "conv_id", F.array_repeat(F.lit(1.0), F.col("c")).alias("x"))
    got = sharding.collated(rows, "g", "x", "conv_id").select("g", F.posexplode("rows").alias("at", "x"))
    ids = rows.groupBy("g").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    met = got.join(ids, "g").select("g", F.get("ids", F.col("at")).alias("conv_id"), "x")
    return met.select("g", "conv_id", F.size(F.filter("x", lambda v: v == 0)).cast("long").alias("zeros"), F.size(F.filter("x", lambda v: v == 1)).cast("long").alias("n"))


@query("""SELECT user_id, frame_index, CAST(floor(CAST(frame_index AS DOUBLE) / 25.0 * 1e9) AS BIGINT) AS at FROM frames WHERE frame_index < 30""")
def s14_flat_table(spark, sf_dir):
    rows = frames_of(spark, sf_dir).select("user_id", "episode_index", "frame_index")
    return flat_robot_table(rows, 25, 30).select("user_id", "frame_index", F.col("timestamp_min").alias("at"))


@query("SELECT '/value' AS topic, count(*) AS n, min(epoch_ns(ts)) AS first FROM events UNION ALL SELECT '/type', count(*), min(epoch_ns(ts)) FROM events")
def s11_episode_messages(spark, sf_dir):
    got = episode_messages(frames_of(spark, sf_dir), {"value": "/value", "event_type": "/type"})
    return got.groupBy("topic").agg(F.count("*").alias("n"), F.min("log_time").alias("first"))


@query("WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events) SELECT event_id FROM p WHERE pos // CAST(ceil(n / 7.0) AS BIGINT) = 3")
def s17_job_slice(spark, sf_dir):
    return job_slice(positions(read(spark, sf_dir, "events").select("event_id"), ["event_id"], "pos"), 7, 3).select("event_id")


@query("SELECT event_id, epoch_ns(ts) >= 1704200000000000000 AS late FROM events")
def u7_split_at(spark, sf_dir):
    log = read(spark, sf_dir, "events").select("event_id", nanoseconds_of().alias("log_time"))
    early, late = messages.split_at(log, 1704200000 * 10**9)
    return early.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query()
def g24_box_clusters(spark, sf_dir):
    return metrics.clusters(read(spark, sf_dir, "embeddings"), "embedding", 10, 7)
