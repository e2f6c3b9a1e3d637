"""Queries of transforms, evaluation states, routing and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.functions import geometry
from kinetrail.operators import evaluation, filters, lookups, messages, metrics, sharding, transforms
from kinetrail.plans.evaluation_queries import _BOXES, _boxes
from kinetrail.plans.registry import query, rounded
from kinetrail.tables import positions, read


@query("SELECT event_id, event_type FROM events WHERE event_id % 11 <> 0 AND event_type IN ('view', 'click', 'purchase')")
def f2_valid_tasks(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("error", F.col("event_id") % 11 == 0)
    return filters.valid_tasks(rows, F.col("error"), F.col("event_type"), ["view", "click", "purchase"]).select("event_id", "event_type")


@query("SELECT doc_id, len(string_split(text, 'the')) - 1 = 0 AS is_unique, len(string_split(text, 'the')) - 1 > 3 AS is_hard FROM documents")
def f12_distractor_flags(spark, sf_dir):
    # Distractors are what lies between mentions.
    parts = F.split(F.col("text"), "the", -1)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.slice(parts, 2, 1 << 30).alias("distractors"))
    return rows.withColumns(filters.distractor_flags(F.col("distractors"))).select("doc_id", "is_unique", "is_hard")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'error')")
def f14_topics(spark, sf_dir):
    return messages.of_topics(read(spark, sf_dir, "events").withColumnRenamed("event_type", "topic"), ["view", "error"]).select("event_id")


@query("SELECT o_orderkey, 7 AS robot, 'arm' AS kind FROM orders")
def p10_constants(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey").transform(transforms.added(robot=7, kind="arm"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def p11_cast(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").transform(transforms.cast({"o_orderkey": "string", "o_custkey": "double", "none": "int"}, strict=False))


@query("SELECT o_orderkey, 1 AS n, o_custkey AS first FROM orders")
def p12_unsqueeze(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").transform(transforms.unsqueezed("o_custkey"))
    return rows.select("o_orderkey", F.size("o_custkey").alias("n"), F.get("o_custkey", F.lit(0)).alias("first"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) + 1, 6) AS gross FROM lineitem")
def x1_mapped_transforms(spark, sf_dir):
    def net(price, discount, fee=0):
        return {"value": price * (1 - discount) + fee}

    def gross(value, tax, fee):
        return {"value": value * (1 + tax) + fee}

    first = transforms.RowTransform(net, {"price": "l_extendedprice", "discount": "l_discount"}, {"value": "net"}, returns=("value",))
    second = transforms.RowTransform(gross, {"value": "net", "tax": "l_tax", "fee": "one"}, {"value": "gross"})
    chain = first + (transforms.Chain() + transforms.added(one=1) + second)
    return read(spark, sf_dir, "lineitem").transform(chain).select("l_orderkey", "l_linenumber", *rounded("net", "gross"))


@query("SELECT o_orderkey AS episode_index, upper(o_orderstatus) AS status, l_linenumber AS frame_index, l_quantity * 2 AS state FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 100000")
def u5_episode_transform(spark, sf_dir):
    from kinetrail.dataset import TrajectoryDataset

    episodes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_index"), "o_orderstatus", "o_totalprice")
    frames = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").alias("frame_index"), "l_quantity")
    change = transforms.EpisodeTransform(F.col("o_totalprice") > 100000, lambda e: e.withColumn("status", F.upper("o_orderstatus")), lambda f: f.withColumn("state", F.col("l_quantity") * 2))
    got = TrajectoryDataset(frames, episodes).transformed(change)
    return got.frames.join(got.episodes, "episode_index").select("episode_index", "status", "frame_index", "state")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '4-NOT SPECIFIED' THEN 'later' ELSE lower(o_orderpriority) END AS task FROM orders")
def c25_task_names(spark, sf_dir):
    task = transforms.task_names({"1-urgent": "now", "4-not_specified": "later"}, F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", task.alias("task"))


@query("SELECT vec_id, round(sqrt(power(x1 - x4, 2) + power(x2 - x5, 2) + power(x3 - x6, 2) + power((s1 - s4) / 2, 2) + power((s2 - s5) / 2, 2) + power((s3 - s6) / 2, 2)), 6) AS distance FROM (SELECT vec_id, "
+ ", ".join(f"CAST(embedding[{k}] AS DOUBLE) AS x{k}, abs(CAST(embedding[{k + 6}] AS DOUBLE)) AS s{k}" for k in range(1, 7)) + " FROM embeddings)")
def c37_box_distance(spark, sf_dir):
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(12)]
    d = geometry.gaussian_wasserstein(e[:3], [F.abs(x) for x in e[6:9]], e[3:6], [F.abs(x) for x in e[9:12]])
    return read(spark, sf_dir, "embeddings").select("vec_id", d.alias("distance")).select("vec_id", *rounded("distance"))


@query("SELECT event_type AS task, round(avg(value), 6) AS mean, max(value) AS most, round(avg(CASE WHEN event_id % 4 = 0 THEN value END), 6) AS last_mean FROM events GROUP BY 1")
def g4_metric_states(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumnRenamed("event_type", "task")
    steps = evaluation.MetricSet({"mean": evaluation.mean_of("value"), "most": evaluation.most_of("value")})
    # States of parts of the table, kept apart and merged.
    parts = [steps.states(rows.where(F.col("event_id") % 3 == k), ["task"]) for k in range(3)]
    whole = steps.results(steps.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["task"]), ["task"])
    ends = evaluation.MetricSet({"last_mean": evaluation.mean_of("value")}).compute(rows.where("event_id % 4 = 0"), ["task"])
    return whole.join(ends, "task").select("task", *rounded("mean"), "most", *rounded("last_mean"))


@query("SELECT user_id, round(avg(value), 6) AS mean, max(CASE WHEN event_id % 4 = 0 THEN value END) AS most FROM events GROUP BY 1")
def g5_channels(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    got = evaluation.channels(rows, F.col("event_id") % 4 == 0, evaluation.MetricSet({"mean": evaluation.mean_of("value")}), evaluation.MetricSet({"most": evaluation.most_of("value")}), ["user_id"])
    return got.select("user_id", *rounded("mean"), "most")


def _split_sql() -> str:
    from kinetrail.plans.registry import ORACLE_SQL

    return f"""SELECT split, threshold, round(avg(ap), 5) AS map, round(avg(recall), 5) AS mar FROM ({ORACLE_SQL['g6_detection_ap']}) JOIN (SELECT unnest(['A', 'N', 'R', 'A']) AS l, unnest(['head', 'head', 'tail', 'tail']) AS split) ON l = label GROUP BY 1, 2"""


@query(_split_sql())
def g8_split_means(spark, sf_dir):
    p, t = _boxes(spark, sf_dir)
    ap = metrics.detection_ap(p, t, [0.25, 0.5], metrics.iou_axis_aligned("p", "t", ("x",)))
    splits = spark.createDataFrame([("A", "head"), ("N", "head"), ("R", "tail"), ("A", "tail")], "label string, split string")
    got = evaluation.split_means(ap, splits)
    return got.select("split", "threshold", *[F.round(c, 5).alias(c) for c in ("map", "mar")])


_AREAS = """WITH """ + _BOXES.rstrip() + """, areas AS (SELECT unnest(['small', 'medium', 'large']) AS area, unnest([0.0, 4.5, 5.5]) AS lo, unnest([4.5, 5.5, 100.0]) AS hi),
ranged AS (SELECT f.*, a.area, f.hit AND NOT (g.s BETWEEN a.lo AND a.hi) AS ign FROM first f CROSS JOIN areas a LEFT JOIN boxes g ON g.id = f.gt),
whole AS (SELECT area, label AS l, count(*) AS n FROM boxes, areas WHERE is_truth AND s BETWEEN lo AND hi GROUP BY 1, 2),
steps AS (SELECT r.area, label, thr, n, row_number() OVER w AS k, sum(tp::INT) OVER w AS c FROM ranged r JOIN whole ON l = label AND whole.area = r.area WHERE NOT ign WINDOW w AS (PARTITION BY r.area, thr, label ORDER BY score DESC, image, pred_id ROWS UNBOUNDED PRECEDING)),
points AS (SELECT area, label, thr, n, k, c / n AS r, c / k AS p FROM steps)
SELECT area, label, CAST(thr AS DOUBLE) AS threshold, n AS n_truths, round(sum(env * (r - prev)), 6) AS ap, round(max(r), 6) AS recall FROM (SELECT *, max(p) OVER (PARTITION BY area, thr, label ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env,
coalesce(lag(r) OVER (PARTITION BY area, thr, label ORDER BY k), 0) AS prev FROM points) GROUP BY 1, 2, 3, 4"""


@query(_AREAS)
def g8_area_ap(spark, sf_dir):
    p, t = _boxes(spark, sf_dir)
    areas = {"small": (0.0, 4.5), "medium": (4.5, 5.5), "large": (5.5, 100.0)}
    got = evaluation.area_ap(p, t, areas, F.col("t_sx"), [0.25, 0.5], metrics.iou_axis_aligned("p", "t", ("x",)))
    return got.select("area", "label", "threshold", "n_truths", *rounded("ap", "recall"))


@query("""SELECT l_returnflag AS label, l_suppkey AS image, count(*) AS n, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2""")
def g9_results_by_class(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_suppkey").alias("image"), F.col("l_extendedprice").alias("score"), "l_orderkey")
    got = evaluation.by_class(rows, ["l_orderkey"])
    return got.select("label", "image", F.size("items").cast("long").alias("n"), F.get("items", F.lit(0))["score"].alias("best"))


@query("""SELECT user_id, event_id, round(m, 6) AS mean_time, round(m * (k_all - k), 6) AS eta FROM (SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS k_all FROM events)""")
def g21_throughput(spark, sf_dir):
    from pyspark.sql import Window

    of = Window.partitionBy("user_id")
    steps = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("duration"))
    steps = steps.withColumn("left", F.count("*").over(of) - F.row_number().over(of.orderBy("step")))
    got = evaluation.throughput(steps, ["user_id"], 5, F.col("left"))
    return got.select("user_id", F.col("step").alias("event_id"), *rounded("mean_time", "eta"))


@query("SELECT event_type, CAST(event_id // 50 AS BIGINT) AS bucket, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def g22_cadence(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumnRenamed("event_id", "step")
    return evaluation.cadence(rows, ["event_type"], 50, "value").select("event_type", "bucket", "n", *rounded("mean"))


@query("SELECT round(avg(v), 6) AS value FROM (SELECT event_id % 8 AS worker, avg(value) AS v FROM events GROUP BY 1)")
def g23_worker_mean(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("worker", F.col("event_id") % 8)
    return evaluation.worker_mean(rows, "worker", ["value"]).select(*rounded("value"))


@query("SELECT user_id, CAST(ceil(count(*) / 8.0) AS BIGINT) AS batches, CAST(floor(count(*) / 8.0) AS BIGINT) AS whole FROM events GROUP BY 1")
def g25_batch_counts(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", sharding.batch_count(F.col("n"), 8).cast("long").alias("batches"), sharding.batch_count(F.col("n"), 8, True).cast("long").alias("whole"))


@query("SELECT max(o_orderkey) AS last FROM orders")
def g27_last_index(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last"))


@query("""WITH e AS (SELECT o_custkey AS part, CAST(ceil(count(*) / 3.0) AS BIGINT) AS size FROM orders GROUP BY 1), b AS (SELECT part, size, coalesce(sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e)
SELECT CAST(s + i AS BIGINT) AS pos, part, i * 3 AS step FROM b, range(0, 1000) t(i) WHERE i < size""")
def j10_strided_steps(spark, sf_dir):
    episodes = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("part")).agg(F.count("*").alias("size"))
    asked = spark.range(episodes.agg(F.sum(F.ceil(F.col("size") / 3))).first()[0] or 0).withColumnRenamed("id", "pos")
    return lookups.steps_of(asked, episodes, 3).select("pos", "part", F.col("step").cast("long").alias("step"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '|' ORDER BY turn, text) AS texts FROM conversations GROUP BY 1")
def j13_texts_of_scans(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return lookups.texts_of(rows, "conv_id", "text", "turn").select("conv_id", F.array_join("texts", "|").alias("texts"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS frame, CAST(p_size AS DOUBLE) AS x FROM part WHERE p_partkey <= 3 UNION ALL SELECT c.p_partkey, p.x + c.p_size FROM part c JOIN p ON c.p_partkey // 4 = p.frame WHERE c.p_partkey > 3)
SELECT frame, x FROM p""")
def j18_transform_paths(spark, sf_dir):
    # A tree of parts: each hangs by its size along x on the one with a quarter of its key.
    size = F.col("p_size").cast("double")
    matrix = F.array(*[size if k == 3 else F.lit(1.0 if k % 5 == 0 else 0.0) for k in range(16)])
    parent = F.when(F.col("p_partkey") <= 3, F.lit("root")).otherwise(F.floor(F.col("p_partkey") / 4).cast("string"))
    edges = read(spark, sf_dir, "part").select(parent.alias("parent"), F.col("p_partkey").cast("string").alias("child"), matrix.alias("matrix"))
    return lookups.transform_paths(edges, "root").select(F.col("frame").cast("long").alias("frame"), F.get("matrix", F.lit(3)).alias("x"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place FROM orders")
def l20_by_time(spark, sf_dir):
    # Places in the sorted table, by range partition.
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("log_time"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("topic"))
    sorted_rows = messages.in_order(rows, descending=True).withColumn("late", -F.col("log_time"))
    return positions(sorted_rows, ["late", "topic"], "place").select("o_orderkey", "place")


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def l2_sql_over_tables(spark, sf_dir):
    from kinetrail.dataset import TrajectoryDataset

    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return TrajectoryDataset(orders, orders, tasks=customers).sql("SELECT c_mktsegment, count(*) AS n FROM {episodes} JOIN {tasks} ON c_custkey = o_custkey GROUP BY 1")


@query("""SELECT o_custkey, i AS shard, CAST(n // 7 + CASE WHEN i < n % 7 THEN 1 ELSE 0 END AS BIGINT) AS plain, CAST(n // 7 AS BIGINT) AS dropped, CAST((n + 6) // 7 AS BIGINT) AS padded FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), range(0, 7) t(i)""")
def l7_sharded_rows(spark, sf_dir):
    # Each customer's orders as a dataset of seven shards.
    sizes = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("shard"))
    of = lambda strategy, name: sharding.shard_rows(F.col("n"), 7, F.col("shard"), strategy).alias(name)
    return sizes.select("o_custkey", F.col("shard").cast("long").alias("shard"), of(None, "plain"), of("drop_last", "dropped"), of("pad_last", "padded"))


@query("SELECT event_id, value FROM events")
def l11_reservoir_shuffle(spark, sf_dir):
    return sharding.reservoir_shuffled(read(spark, sf_dir, "events").select("event_id", "value"), 256, 32, 5)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r <= 4""")
def s20_capped_episodes(spark, sf_dir):
    valid = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return lookups.capped(valid, "o_custkey", "o_orderkey", 4).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_custkey AS task, max(o_orderkey) AS attempt, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def t7_last_attempts(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("status"))
    return evaluation.last_attempts(rows, ["task"], "attempt")


@query("""SELECT o_custkey AS task, count(*) AS n_attempts, greatest(1000, max(o_orderkey) + 1) AS next_seed FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) <> 'F' AND count(*) < 12""")
def t7_retry_and_seeds(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("status"))
    again = evaluation.to_retry(rows, ["task"], "attempt", F.col("status") == "F", 12)
    return again.join(evaluation.next_seed(rows, "task", "attempt", 1000), "task").select("task", "n_attempts", "next_seed")


@query("""SELECT user_id, count(*) AS n_steps, CASE WHEN bool_or(event_type = 'purchase') THEN 'success' WHEN count(*) >= 20 THEN 'timeout' ELSE 'stopped' END AS reason FROM events GROUP BY 1""")
def t8_episode_ends(spark, sf_dir):
    got = evaluation.episode_ends(read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase", 20)
    return got.select("user_id", "n_steps", "reason")
