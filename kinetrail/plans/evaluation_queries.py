"""Queries of metrics and message logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.operators import messages, metrics
from kinetrail.plans.registry import nanoseconds_of, query, rounded
from kinetrail.tables import read


@query("""SELECT event_type AS task, count(*) AS n, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_success, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1""")
def g3_success_rates(spark, sf_dir):
    results = read(spark, sf_dir, "events").withColumns({"task": F.col("event_type"), "ok": F.col("value") > 10})
    return metrics.success_rates(results, "task", "ok").withColumn("rate", F.round("rate", 6))


@query("""SELECT round(avg(rate), 6) AS macro_rate, count(*) AS n_tasks FROM (SELECT user_id, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1)""")
def g3_macro_rate(spark, sf_dir):
    results = read(spark, sf_dir, "events").withColumn("ok", F.col("value") > 10)
    return metrics.macro_rate(metrics.success_rates(results, "user_id", "ok")).withColumn("macro_rate", F.round("macro_rate", 6))


@query("""SELECT count(*) AS n, round(avg(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END), 6) AS distance, round(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END) / count(*), 6) AS spl FROM events""")
def g29_navigation_summary(spark, sf_dir):
    bad = F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = read(spark, sf_dir, "events").select(bad.alias("distance"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("spl"))
    return metrics.navigation_summary(rows, ["distance"], ["spl"]).select("n", *rounded("distance", "spl"))


#: Boxes made of line items: one axis, images are suppliers, classes return flags, every fourth part a truth.
_BOXES = """boxes AS (SELECT l_suppkey AS image, l_returnflag AS label, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS id,
l_partkey % 400 / 10.0 AS x, 4.0 + l_linenumber % 3 AS s, CAST(l_extendedprice AS DOUBLE) AS score, l_partkey % 4 = 0 AS is_truth FROM lineitem),
pair AS (SELECT p.image, p.label, p.id AS pred_id, p.score, t.id AS gt_id,
greatest(least(p.x + p.s / 2, t.x + t.s / 2) - greatest(p.x - p.s / 2, t.x - t.s / 2), 0) AS i, p.s + t.s AS u FROM (SELECT * FROM boxes WHERE NOT is_truth) p
LEFT JOIN (SELECT * FROM boxes WHERE is_truth) t ON t.image = p.image AND t.label = p.label),
aim AS (SELECT image, label, pred_id, score, max(i / (u - i)) AS iou, arg_max(gt_id, (i / (u - i), -gt_id)) AS gt FROM pair GROUP BY 1, 2, 3, 4),
judged AS (SELECT *, coalesce(iou > thr, false) AS hit FROM aim, (SELECT unnest([0.25, 0.5]) AS thr)),
first AS (SELECT *, hit AND row_number() OVER (PARTITION BY thr, label, image, hit, gt ORDER BY score DESC, pred_id) = 1 AS tp FROM judged),
total AS (SELECT label AS l, count(*) AS n_truths FROM boxes WHERE is_truth GROUP BY 1),
run AS (SELECT label, thr, n_truths, row_number() OVER w AS k, sum(tp::INT) OVER w AS c FROM first JOIN total ON l = label WINDOW w AS (PARTITION BY thr, label ORDER BY score DESC, image, pred_id ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT label, thr, n_truths, k, c / n_truths AS r, c / k AS p FROM run)
"""


def _boxes(spark, sf_dir, *more):
    from kinetrail.tables import positions

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = positions(read(spark, sf_dir, "lineitem").select(*order, "l_returnflag", *more), order, "id")
    boxes = rows.select(F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("label"), (F.col("id") + 1).alias("id"), (F.col("l_partkey") % 400 / 10.0).alias("x"), (F.col("l_linenumber") % 3 + 4.0).alias("s"), F.col("l_extendedprice").alias("score"), "l_partkey", *more)
    truth = F.col("l_partkey") % 4 == 0
    p = boxes.where(~truth).select("image", "label", F.col("id").alias("pred_id"), "score", F.col("x").alias("p_x"), F.col("s").alias("p_sx"), *more)
    return p, boxes.where(truth).select("image", "label", F.col("id").alias("gt_id"), F.col("x").alias("t_x"), F.col("s").alias("t_sx"), *more)


def _ap(spark, sf_dir, mode):
    p, t = _boxes(spark, sf_dir)
    got = metrics.detection_ap(p, t, [0.25, 0.5], metrics.iou_axis_aligned("p", "t", ("x",)), mode)
    return got.select("label", "threshold", "n_truths", *rounded("ap", "recall"))


@query("WITH " + _BOXES + """SELECT label, CAST(thr AS DOUBLE) AS threshold, n_truths, round(sum(env * (r - prev)), 6) AS ap, round(max(r), 6) AS recall FROM (SELECT *, max(p) OVER (PARTITION BY thr, label ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env,
coalesce(lag(r) OVER (PARTITION BY thr, label ORDER BY k), 0) AS prev FROM curve) GROUP BY 1, 2, 3""")
def g6_detection_ap(spark, sf_dir):
    return _ap(spark, sf_dir, "area")


@query("WITH " + _BOXES + """SELECT label, CAST(thr AS DOUBLE) AS threshold, n_truths, round(avg(m), 6) AS ap, round(max(top), 6) AS recall FROM (SELECT label, thr, n_truths, t, coalesce(max(CASE WHEN r >= t / 10.0 THEN p END), 0) AS m, max(r) AS top
FROM curve, range(0, 11) g(t) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def g7_ap_11_points(spark, sf_dir):
    return _ap(spark, sf_dir, "11points")


@query("""WITH g AS (SELECT l_suppkey % 20 AS scene, l_tax * 10 AS score, row_number() OVER (PARTITION BY l_suppkey % 20 ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem)
SELECT scene, CAST(f AS DOUBLE) AS friction, k, round(sum(CASE WHEN score > 0 AND score <= f THEN 1 ELSE 0 END) / k, 6) AS accuracy FROM g, (SELECT unnest([0.2, 0.4, 0.8]) AS f), range(1, 21) t(k) WHERE r <= k GROUP BY 1, 2, 3""")
def g11_grasp_accuracy(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    g = rows.select((F.col("l_suppkey") % 20).alias("scene"), (F.col("l_tax") * 10).alias("score"), F.col("l_extendedprice").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("grasp_id"))
    got = metrics.grasp_accuracy(g, ["scene"], [0.2, 0.4, 0.8])
    return got.select("scene", "friction", F.col("k").cast("long").alias("k"), *rounded("accuracy"))


_ACTIONS = "a AS (SELECT vec_id, label, t, d, CAST(embedding[t * 8 + d + 1] AS DOUBLE) AS x, CAST(embedding[(t * 8 + d + 13) % 64 + 1] AS DOUBLE) AS y FROM embeddings, range(0, 8) r(t), range(0, 8) s(d))\n"


def _actions(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    step = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.struct(F.slice(e, t * 8 + 1, 8).alias("pred"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: F.get(e, (t * 8 + d + 13) % 64)).alias("truth")))).alias("step", "s")
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", step).select("vec_id", "label", "step", "s.pred", "s.truth")


@query("WITH " + _ACTIONS + """, m AS (SELECT vec_id, d, avg(abs(x - y)) AS m, max(CASE WHEN t = 7 THEN abs(x - y) END) AS f FROM a GROUP BY 1, 2)
SELECT vec_id, round(max(CASE WHEN d = 0 THEN m END), 6) AS average_joint, round(sqrt(sum(CASE WHEN d BETWEEN 1 AND 3 THEN m * m ELSE 0 END)), 6) AS average_xyz, round(sqrt(sum(CASE WHEN d BETWEEN 4 AND 7 THEN m * m ELSE 0 END)), 6) AS average_quat,
round(max(CASE WHEN d = 0 THEN f END), 6) AS final_joint, round(sqrt(sum(CASE WHEN d BETWEEN 1 AND 3 THEN f * f ELSE 0 END)), 6) AS final_xyz, round(sqrt(sum(CASE WHEN d BETWEEN 4 AND 7 THEN f * f ELSE 0 END)), 6) AS final_quat FROM m GROUP BY 1""")
def g13_action_errors(spark, sf_dir):
    got = metrics.action_errors(_actions(spark, sf_dir), ["vec_id"])
    return got.select("vec_id", *rounded(*[f"{w}_{p}" for w in ("average", "final") for p in ("joint", "xyz", "quat")]))


@query("WITH " + _ACTIONS + """, j AS (SELECT vec_id, t, d, x - 3 * lag(x, 1) OVER w + 3 * lag(x, 2) OVER w - lag(x, 3) OVER w AS j FROM a WINDOW w AS (PARTITION BY vec_id, d ORDER BY t)),
n AS (SELECT vec_id, t, sqrt(sum(j * j)) AS n FROM j WHERE d BETWEEN 1 AND 3 GROUP BY 1, 2)
SELECT vec_id, round(q.jerk, 6) AS jerk, round(avg(n), 6) AS jerk_xyz FROM n JOIN (SELECT vec_id, avg(abs(j)) AS jerk FROM j WHERE d = 0 GROUP BY 1) q USING (vec_id) GROUP BY 1, q.jerk""")
def g13_jerk(spark, sf_dir):
    return metrics.jerks(_actions(spark, sf_dir), ["vec_id"]).select("vec_id", *rounded("jerk", "jerk_xyz"))


@query("""SELECT event_type AS name, event_id // 100 AS "window", round(avg(value), 6) AS mean_loss, arg_max(value, event_id) AS last_loss FROM events GROUP BY 1, 2""")
def g20_windowed_losses(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return metrics.windowed_losses(rows, 100).withColumn("mean_loss", F.round("mean_loss", 6))


@query("""SELECT image, query, label, round(1 / (1 + exp(-x)), 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY x DESC, query, label) AS r FROM
(SELECT label AS image, vec_id AS query, k - 1 AS label, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(k))) WHERE r <= 300""")
def l23_detection_top_k(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("e"))
    got = metrics.top_scores(rows, "image", "e", 300)
    return got.select("image", "query", F.col("label").cast("long").alias("label"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _log(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), nanoseconds_of().alias("log_time"), F.col("value").alias("data"), "event_id", "user_id")


@query("SELECT event_type AS topic, count(*) AS n, min(epoch_ns(ts)) AS min_log_time, max(epoch_ns(ts)) AS max_log_time FROM events GROUP BY 1")
def g15_topic_ranges(spark, sf_dir):
    return messages.topic_ranges(_log(spark, sf_dir))


@query("""SELECT CAST(sum(n) AS BIGINT) AS n, string_agg(topic, ',' ORDER BY f) AS topics, min(lo) AS min_log_time, max(hi) AS max_log_time FROM
(SELECT event_type AS topic, count(*) AS n, min(event_id) AS f, min(epoch_ns(ts)) AS lo, max(epoch_ns(ts)) AS hi FROM events GROUP BY 1)""")
def g14_log_summary(spark, sf_dir):
    return messages.summary(_log(spark, sf_dir), "event_id")


@query("""SELECT string_agg(topic, ',' ORDER BY topic) AS topics, lo * 86400000000000 AS start, (hi + 1) * 86400000000000 AS "end" FROM
(SELECT CAST(user_id AS VARCHAR) AS topic, min(epoch_ns(ts)) // 86400000000000 AS lo, max(epoch_ns(ts)) // 86400000000000 AS hi FROM events GROUP BY 1) GROUP BY lo, hi""")
def g16_group_ranges(spark, sf_dir):
    return messages.record_chunks(_log(spark, sf_dir).withColumn("topic", F.col("user_id").cast("string")), 86400 * 10**9)


@query("""SELECT event_id FROM events, (SELECT min(epoch_ns(ts)) AS t0 FROM events) WHERE event_type IN ('view', 'error') AND epoch_ns(ts) >= t0 + 3600000000000 AND epoch_ns(ts) < t0 + 90000000000000""")
def j16_replay(spark, sf_dir):
    log = _log(spark, sf_dir)
    start = log.agg(F.min("log_time").alias("t")).select(F.lit("view,error").alias("topics"), (F.col("t") + 3600 * 10**9).alias("start"), (F.col("t") + 90000 * 10**9).alias("end"))
    return messages.replayed(log, start).select("event_id")


@query("""SELECT event_id FROM events, (SELECT min(epoch_ns(ts)) AS t0 FROM events) WHERE event_type = 'click' AND epoch_ns(ts) >= t0 + 86400000000000 AND epoch_ns(ts) < t0 + 259200000000000""")
def t4_time_range(spark, sf_dir):
    return messages.time_range(_log(spark, sf_dir), 86400 * 10**9, 2 * 86400 * 10**9).where("topic = 'click'").select("event_id")


_BATCH = """SELECT event_id, user_id, event_type, value, ts, greatest(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 0) // 3 AS batch FROM events"""


@query(f"SELECT event_id, CAST(batch AS BIGINT) AS batch FROM ({_BATCH})")
def t1_batch_by_count(spark, sf_dir):
    return messages.batch_by_count(_log(spark, sf_dir), "view", 3, ["log_time", "event_id"], ["user_id"]).select("event_id", "batch")


@query(f"SELECT event_id, CAST(batch AS BIGINT) AS batch FROM ({_BATCH})")
def t2_batch_state_machine(spark, sf_dir):
    """The state machine with least = most = 3, which a running count can check."""
    return messages.batched(_log(spark, sf_dir), (messages.Monitor("view", 3, 3, 10**18),), "user_id", ["log_time", "event_id"]).select("event_id", "batch")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS last_view, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER w AS last_error
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def j15_last_message(spark, sf_dir):
    return messages.last_of_topics(_log(spark, sf_dir), ["view", "error"], ["log_time", "event_id"], ["user_id"]).select("event_id", "last_view", "last_error")


@query(f"""WITH b AS ({_BATCH}), keys AS (SELECT * FROM (SELECT DISTINCT user_id, batch FROM b) JOIN (SELECT DISTINCT user_id, event_type FROM b) USING (user_id))
SELECT k.user_id, CAST(k.batch AS BIGINT) AS batch, k.event_type AS topic, arg_max(b.value, (b.ts, b.value)) AS data FROM keys k JOIN b ON b.user_id = k.user_id AND b.event_type = k.event_type AND b.batch < k.batch GROUP BY 1, 2, 3""")
def j15_carried(spark, sf_dir):
    batches = messages.batch_by_count(_log(spark, sf_dir), "view", 3, ["log_time", "event_id"], ["user_id"])
    return messages.carried(batches, ["user_id"]).select("user_id", "batch", "topic", "data")


@query("""SELECT event_id, epoch_ns(ts) - min(epoch_ns(ts)) OVER (PARTITION BY event_type) + 1000 AS log_time FROM events""")
def c28_align_log_time(spark, sf_dir):
    return messages.aligned(_log(spark, sf_dir), ["log_time"], F.lit(1000)).select("event_id", "log_time")


@query("""SELECT topic, round(max(apart), 6) AS worst, round(avg(apart), 6) AS mean FROM (SELECT b.event_id, 'click' AS topic, min(abs(epoch_ns(m.ts) - epoch_ns(b.ts))) / 1e9 AS apart
FROM events b JOIN events m ON m.user_id = b.user_id AND m.event_type = 'click' WHERE b.event_type = 'view' GROUP BY 1) GROUP BY 1""")
def g17_sync_quality(spark, sf_dir):
    from kinetrail.operators import temporal

    log = _log(spark, sf_dir)
    base = log.where("topic = 'view'").select("user_id", "event_id", "log_time")
    got = temporal.nearest(base, log.where("topic = 'click'").select("user_id", F.col("event_id").alias("near"), "log_time"), "near", ["user_id"]).where("near is not null")
    apart = F.col("apart") / 1e9
    return got.groupBy(F.lit("click").alias("topic")).agg(F.round(F.max(apart), 6).alias("worst"), F.round(F.avg(apart), 6).alias("mean"))
