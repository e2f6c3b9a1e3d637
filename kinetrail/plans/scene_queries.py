"""Queries of log import, conversion, annotations, boxes, clouds and cameras."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from kinetrail.functions import geometry, scenes
from kinetrail.operators import evaluation, imports, metrics, transforms
from kinetrail.plans.evaluation_queries import _BOXES, _boxes
from kinetrail.plans.registry import nanoseconds_of, query, rounded
from kinetrail.sources.store import saved
from kinetrail.tables import positions, read, shared_dir


def _messages(spark, sf_dir):
    """Events as the JSON messages of their users' logs."""
    events = read(spark, sf_dir, "events").withColumn("log_time", nanoseconds_of())
    data = F.encode(F.to_json(F.struct(F.col("value").alias("v"), F.col("event_id").alias("id"))), "UTF-8")
    return events.select("user_id", F.col("event_type").alias("topic"), "log_time", F.col("event_id").alias("sequence"), data.alias("data"))


@query("SELECT event_id AS sequence, round(value, 6) AS v FROM events WHERE event_type = 'click'")
def s9_decoded(spark, sf_dir):
    got = imports.decoded(_messages(spark, sf_dir), "click", "v double, id long")
    return got.select(F.col("message.id").alias("sequence"), F.round("message.v", 6).alias("v"))


@query("""WITH e AS (SELECT *, epoch_ns(ts) AS t FROM events),
base AS (SELECT * FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM e WHERE event_type = 'view') WHERE d IS NULL OR abs(d) > 10),
met AS (SELECT b.user_id, b.event_id, b.t, b.value, arg_min(m.value, (abs(m.t - b.t), m.t, m.value, m.event_id)) AS click, min(abs(m.t - b.t)) AS apart FROM base b LEFT JOIN e m ON m.user_id = b.user_id AND m.event_type = 'click' GROUP BY ALL)
SELECT row_number() OVER (ORDER BY user_id, t, event_id) - 1 AS "index", row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS frame_index, event_id AS sequence, round(value, 6) AS view,
round(CASE WHEN apart <= 86400000000000 THEN click END, 6) AS click FROM met""")
def s15_log_import(spark, sf_dir):
    base, click = imports.Stream("view", "v double, id long", {"view": "v"}), imports.Stream("click", "v double, id long", {"click": "v", "click_id": "id"})
    got = imports.log_frames(_messages(spark, sf_dir), "user_id", ["log_time", "sequence"], base, [click], 86_400_000_000_000, "view", 10)
    return got["frames"].select("index", "frame_index", "sequence", *rounded("view", "click"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def s22_saved_indices(spark, sf_dir):
    order = positions(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "place")
    return saved(order.select("o_orderkey", "place"), f"{shared_dir(spark).rstrip('/')}/kinetrail/indices-{uuid4().hex}")


@query("""SELECT user_id, event_type AS topic, min(event_id) AS first, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events)
GROUP BY user_id, event_type, run""")
def t5_stateful_converter(spark, sf_dir):
    # Runs of messages of one topic become one; the last of a log only comes with its end.
    def step(state, message):
        done = flush(state) if state["topic"] != message.topic else []
        if done or state["topic"] is None:
            state.update(topic=message.topic, first=message.event_id, n=0)
        state["n"] += 1
        return done

    def flush(state):
        return [(state["log"], state["topic"], state["first"], state["n"])] if state["topic"] is not None else []

    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("topic"), "event_id")
    return imports.converted(rows, "user_id", ["event_id"], lambda log: {"log": log, "topic": None, "first": None, "n": 0}, step, flush, "user_id long, topic string, first long, n long")


@query("SELECT event_id, epoch_ns(ts) AS log_time FROM events")
def t3_ascending(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", nanoseconds_of().alias("log_time"))
    return imports.ascending(rows, "user_id", ["log_time", "event_id"]).select("event_id", "log_time")


@query("""SELECT scene, id, label, large, taxed, count(*) AS n FROM (
SELECT l_orderkey AS scene, l_linenumber AS id, l_returnflag AS label, bool_or(l_quantity > 25) OVER w AS large, bool_or(l_tax > 0.04) OVER w AS taxed
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey)) GROUP BY ALL""")
def p18_annotations(spark, sf_dir):
    # Orders as scenes, their lines as instances: the large and the highly taxed ones in two views.
    line = F.struct(F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "l_linenumber", F.col("l_returnflag").alias("label"))
    seen = [F.collect_list(F.when(c, line["id"])) for c in (F.col("l_quantity") > 25, F.col("l_tax") > 0.04)]
    made = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scene")).agg(F.collect_list(line).alias("instances"), F.array(*seen).alias("views"))
    got = imports.annotations(made, "scene", "instances", "views")
    keys = ["scene", F.col("l_linenumber").alias("id"), "label", F.get("visible", F.lit(0)).alias("large"), F.get("visible", F.lit(1)).alias("taxed")]
    return got.groupBy(*keys).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 3) = 3")
def f18_with_files(spark, sf_dir):
    listing = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("_episode"), F.concat(F.lit("video_"), "l_linenumber").alias("_file"))
    wanted = F.array(*[F.lit(f"video_{k}") for k in (1, 2, 3)])
    return imports.with_files(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), wanted, listing, "o_orderkey")


@query("""SELECT o_orderstatus AS dataset, o_custkey AS episode_index, row_number() OVER w - 1 AS episode, CAST(sum(count(*)) OVER w - count(*) AS BIGINT) AS start, CAST(sum(count(*)) OVER w AS BIGINT) AS "end"
FROM orders GROUP BY 1, 2 WINDOW w AS (ORDER BY o_orderstatus, o_custkey ROWS UNBOUNDED PRECEDING)""")
def p16_episode_ranges(spark, sf_dir):
    episodes = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_custkey").alias("episode_index")).agg(F.count("*").alias("frame_num"))
    return imports.episode_ranges(episodes).select("dataset", "episode_index", "episode", "start", "end")


@query("""SELECT CAST(p // 32 AS BIGINT) AS batch, min(o_orderkey) AS first_key, round(sum(o_totalprice), 2) AS total FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1""")
def x6_collate(spark, sf_dir):
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 2)
    got = imports.collated(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), ["o_orderkey"], 32, {"o_orderkey": F.array_min, "o_totalprice": total})
    return got.select("batch", F.col("o_orderkey").alias("first_key"), F.col("o_totalprice").alias("total"))


_PARTS = _BOXES.replace("l_returnflag AS label", "l_returnflag || l_linestatus AS label")


@query("WITH " + _PARTS + """SELECT label[2:] AS part, label[:1] AS label, CAST(thr AS DOUBLE) AS threshold, n_truths, round(sum(env * (r - prev)), 6) AS ap, round(max(r), 6) AS recall FROM (SELECT *, max(p) OVER (PARTITION BY thr, label ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env,
coalesce(lag(r) OVER (PARTITION BY thr, label ORDER BY k), 0) AS prev FROM curve) GROUP BY 1, 2, 3, 4""")
def g10_part_ap(spark, sf_dir):
    p, t = _boxes(spark, sf_dir, "l_linestatus")
    got = evaluation.part_ap(p, t, "l_linestatus", [0.25, 0.5], metrics.iou_axis_aligned("p", "t", ("x",)))
    return got.select(F.col("l_linestatus").alias("part"), "label", "threshold", "n_truths", *rounded("ap", "recall"))


@query("SELECT o_orderkey, 2.0::DOUBLE AS scale, 0.5::DOUBLE AS shift FROM orders")
def c9_scale_shift(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey").transform(transforms.scaled(2, 0.5))


_E = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(12))


def _components(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(12)])


@query(f"SELECT vec_id, round((e0 + 1) * (e2 - e5) + e4 * (e4 - 2 * e3), 6) AS u FROM (SELECT vec_id, {_E} FROM embeddings)")
def c16_projection(spark, sf_dir):
    # A camera at (e5, 0, 2 e3) without rotation sees the point (e2, 0, e4): u before the division by depth.
    e = [F.col(f"e{k}") for k in range(12)]
    zero, one = F.lit(0.0), F.lit(1.0)
    k = geometry.intrinsic_4x4(F.array(e[0] + 1, zero, e[4], zero, e[0] + 1, e[4], zero, zero, one))
    pose = geometry.pose_matrix(F.array(e[5], zero, 2 * e[3]), F.array(one, zero, zero, zero))
    whole = geometry.projection(k, geometry.inverse_rigid(pose))
    rows = _components(spark, sf_dir).select("vec_id", geometry.moved(whole, [e[2], zero, e[4]])[0].alias("u"))
    return rows.select("vec_id", *rounded("u"))


_SIZES = "abs(e3) + 0.1 AS a3, abs(e4) + 0.1 AS a4, abs(e5) + 0.1 AS a5, abs(e9) + 0.1 AS b3, abs(e10) + 0.1 AS b4, abs(e11) + 0.1 AS b5"


@query(f"""SELECT vec_id, round(i / (a3 * a4 * a5 + b3 * b4 * b5 - i), 6) AS iou FROM (SELECT *, greatest(least(e0 + a4 / 2, e6 + b3 / 2) - greatest(e0 - a4 / 2, e6 - b3 / 2), 0) * greatest(least(e1 + a3 / 2, e7 + b4 / 2) - greatest(e1 - a3 / 2, e7 - b4 / 2), 0)
* greatest(least(e2 + a5 / 2, e8 + b5 / 2) - greatest(e2 - a5 / 2, e8 - b5 / 2), 0) AS i FROM (SELECT *, {_SIZES} FROM (SELECT vec_id, {_E} FROM embeddings)))""")
def c20_rotated_iou(spark, sf_dir):
    # The first box is turned by a quarter about z, so that the SQL can swap its sizes.
    e = [F.col(f"e{k}") for k in range(12)]
    turned, straight = (F.array(*[F.lit(float(v)) for v in m]) for m in ((0, -1, 0, 1, 0, 0, 0, 0, 1), (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    a = scenes.box(e[:3], [F.abs(x) + 0.1 for x in e[3:6]], turned)
    b = scenes.box(e[6:9], [F.abs(x) + 0.1 for x in e[9:12]], straight)
    return _components(spark, sf_dir).select("vec_id", F.round(scenes.iou_rotated(a, b), 6).alias("iou"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN (SELECT l_suppkey AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_tax) AS lt, max(l_tax) AS ht FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON s = l_suppkey
WHERE l_quantity BETWEEN lo AND hi AND l_tax BETWEEN lt AND ht""")
def f10_in_cloud(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_returnflag")
    return scenes.in_cloud(lines, lines.where("l_returnflag = 'A'"), "l_suppkey", ("l_quantity", "l_tax")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), d AS (SELECT s_suppkey, i, (2 * i + 1) / n::DOUBLE - 1 AS z FROM s)
SELECT s_suppkey, round(sqrt(1 - z * z) * cos(i * pi() * (sqrt(5) - 1)), 6) AS x, round(sqrt(1 - z * z) * sin(i * pi() * (sqrt(5) - 1)), 6) AS y, round(z, 6) AS z, round(sqrt(1 - z * z), 6) AS side FROM d""")
def c38_viewpoints(spark, sf_dir):
    # A view for each supplier, and how far the second axis of a frame that looks along it turns from level.
    from kinetrail.tables import positions

    suppliers = positions(read(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], "at")
    views = scenes.viewpoints(spark, suppliers.count())
    turned = scenes.view_rotation([F.col("x"), F.col("y"), F.col("z")], F.lit(0.0))
    got = suppliers.join(views, F.col("at") == F.col("view")).withColumn("side", F.abs(F.get(turned, F.lit(8))))
    return got.select("s_suppkey", *rounded("x", "y", "z", "side"))


@query(f"""WITH e AS (SELECT vec_id, vec_id % 20 AS scene, {_E} FROM embeddings)
SELECT g.vec_id, count(p.vec_id) FILTER (abs(p.e0 - g.e0) <= 0.1 AND abs(p.e1 - g.e1) <= 0.1 AND abs(p.e2 - g.e2) <= 0.1) AS fingers, count(p.vec_id) FILTER (p.e0 - g.e0 BETWEEN 0 AND 0.2 AND abs(p.e1 - g.e1) <= 0.1 AND abs(p.e2 - g.e2) <= 0.1) AS palm
FROM e g JOIN e p ON p.scene = g.scene GROUP BY 1""")
def c35_collision_counts(spark, sf_dir):
    rows = _components(spark, sf_dir).select("vec_id", (F.col("vec_id") % 20).alias("scene"), F.col("e0").alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z"))
    regions = {"fingers": ([-0.1] * 3, [0.1] * 3), "palm": ([0.0, -0.1, -0.1], [0.2, 0.1, 0.1])}
    return scenes.collision_counts(rows, rows.drop("vec_id"), ["scene"], regions, "vec_id").select("vec_id", "fingers", "palm")


@query()
def l24_grasp_suppression(spark, sf_dir):
    # Rounds of a greedy choice are beyond SQL; tests hold the operator against the choice one by one.
    rows = _components(spark, sf_dir).select("vec_id", (F.col("vec_id") % 20).alias("scene"), F.col("e0").alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z"), F.col("e3").alias("score"))
    return scenes.suppressed(rows, ["scene"], "vec_id", "score", 0.1, 30).select("scene", "vec_id", *rounded("score"))


@query("SELECT l_orderkey, l_partkey::VARCHAR AS child, round(l_quantity, 6)::DOUBLE AS x, round(l_tax, 6)::DOUBLE AS y, -1.0::DOUBLE AS turned FROM lineitem")
def s13_transform_batches(spark, sf_dir):
    # The lines of an order as one message of transforms, each turned by a quarter about z, and back.
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("base").alias("parent"), F.col("l_partkey").cast("string").alias("child"), F.array(*[c.cast("double") for c in (F.col("l_quantity"), F.col("l_tax"), F.lit(0))]).alias("translation"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0))).alias("rotation"))
    got = imports.transforms_of(imports.transform_messages(rows, "/tf", ["l_orderkey"]), "/tf", ["l_orderkey"])
    return got.select("l_orderkey", "child", *[F.round(F.get("matrix", F.lit(k)), 6).alias(n) for k, n in ((3, "x"), (7, "y"), (1, "turned"))])


@query("SELECT p_partkey, 'cam' AS frame, p_size::BIGINT AS width, p_size + 0.5::DOUBLE AS fx, 1.0::DOUBLE AS last FROM part")
def s13_calibrations(spark, sf_dir):
    size = F.col("p_size").cast("double")
    k = F.array(*[size + 0.5 if i in (0, 4) else F.lit(float(i == 8)) for i in range(9)])
    message = F.struct(F.lit("cam").alias("frame_id"), F.col("p_size").alias("width"), F.col("p_size").alias("height"), F.array(F.lit(0.1)).alias("D"), k.alias("K"))
    messages = read(spark, sf_dir, "part").select("p_partkey", F.lit("calibration").alias("topic"), F.to_json(message).alias("data"))
    got = imports.calibrations_of(messages, "calibration", ["p_partkey"])
    return got.select("p_partkey", "frame", "width", F.get("intrinsic", F.lit(0)).alias("fx"), F.get("intrinsic", F.lit(15)).alias("last"))
