"""Queries of message logs: files by their index, binary messages, carried messages, mixes and quarantined episodes."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from kinetrail.functions import depths, geometry, tables
from kinetrail.functions.wire import Field, Layout
from kinetrail.operators import assembly, imports, messages, sharding, temporal
from kinetrail.plans.registry import frames_of, nanoseconds_of, query, rounded
from kinetrail.sources import arrow_source, mcap_source, robots, store
from kinetrail.tables import read, shared_dir

_TIMES = "WITH e AS (SELECT event_id, event_type, epoch_ns(ts) AS log_time FROM events), s AS (SELECT min(log_time) AS lo, max(log_time) AS hi FROM e) "


@query(_TIMES + "SELECT event_id, event_type AS topic, log_time FROM e, s WHERE event_type = 'purchase' AND log_time >= lo + (hi - lo) // 4 AND log_time < lo + (hi - lo) // 4 * 3")
def s8_log_source(spark, sf_dir):
    mcap_source.register(spark)
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), nanoseconds_of().alias("log_time"), F.col("event_id").cast("string").cast("binary").alias("data"))
    at = f"{shared_dir(spark).rstrip('/')}/kinetrail/logs-{uuid4().hex}"
    # Files of consecutive times, each in the order of time.
    rows.repartitionByRange("log_time").sortWithinPartitions("log_time").write.format("mcap").mode("append").save(at)
    low, high = rows.agg(F.min("log_time"), F.max("log_time")).first()
    quarter = (high - low) // 4
    got = spark.read.format("mcap").load(at).where((F.col("topic") == "purchase") & (F.col("log_time") >= low + quarter) & (F.col("log_time") < low + 3 * quarter))
    return got.select(F.decode("data", "UTF-8").cast("long").alias("event_id"), "topic", "log_time")


_DAYS = """WITH n AS (SELECT user_id, event_id, event_type, value, epoch_ns(ts) // 86400000000000 AS day, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ns(ts) // 86400000000000, event_id) - 1 AS k FROM events),
b AS (SELECT *, max(k // 3) OVER (PARTITION BY user_id, day) AS batch FROM n)
"""


@query(_DAYS + """SELECT k.user_id, CAST(k.batch AS BIGINT) AS batch, k.event_type AS topic, arg_max(b.value, (b.day, b.value)) AS data FROM (SELECT DISTINCT user_id, batch, event_type FROM (SELECT DISTINCT user_id, batch FROM b) JOIN (SELECT DISTINCT user_id, event_type FROM b) USING (user_id)) k
JOIN b ON b.user_id = k.user_id AND b.event_type = k.event_type AND b.batch <= k.batch GROUP BY 1, 2, 3""")
def t5_last_messages(spark, sf_dir):
    # Days are log times, so that many messages have the same; a batch is cut after three, and messages of the cut's day move on.
    day = F.floor(nanoseconds_of() / 86_400_000_000_000).cast("long")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("topic"), F.col("value").alias("data"), day.alias("log_time"))
    any_topic = rows.withColumns({"kind": F.col("topic"), "topic": F.lit("any")})
    placed = messages.batched(any_topic, (messages.Monitor("any", 3, 3, 1 << 40),), "user_id", ["log_time", "event_id"]).withColumn("topic", F.col("kind")).drop("kind")
    return messages.last_messages(placed, ["user_id"]).select("user_id", "batch", "topic", "data")


_EVENT = Layout((Field("id", "int64", 1), Field("user", "sint64", 2), Field("value", "double", 3), Field("kinds", "string", 4, -1), Field("at", Layout((Field("sec", "int32", 1), Field("nanosec", "uint32", 2))), 5), Field("twice", "int64", 6, -1)))


@query("SELECT event_id, user_id, value, event_type, epoch_ns(ts) AS log_time, event_id * 2 AS twice FROM events")
def s10_binary_messages(spark, sf_dir):
    # Each third of the events in an encoding of its own; the reader goes by the message's encoding.
    time = nanoseconds_of()
    at = F.struct(F.floor(time / 1_000_000_000).cast("int").alias("sec"), F.pmod(time, F.lit(1_000_000_000)).alias("nanosec"))
    message = F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("value"), F.array("event_type").alias("kinds"), at.alias("at"), F.array(F.lit(-1).cast("long"), F.col("event_id") * 2).alias("twice"))
    kinds = ("json", "protobuf", "cdr")
    rows = read(spark, sf_dir, "events").select(F.lit("events").alias("topic"), message.alias("m"), F.element_at(F.array(*map(F.lit, kinds)), (F.pmod("event_id", F.lit(3)) + 1).cast("int")).alias("encoding"))
    of = lambda e: F.when(F.col("encoding") == e, F.col("m"))
    sent = rows.select("topic", "encoding", F.coalesce(*[imports.encoded_as(of(e), _EVENT, e) for e in kinds]).alias("data"))
    m = F.col("message")
    got = imports.decoded_by_encoding(sent, "events", _EVENT)
    time = m["at"]["sec"].cast("long") * 1_000_000_000 + m["at"]["nanosec"]
    return got.select(m["id"].alias("event_id"), m["user"].alias("user_id"), m["value"].alias("value"), F.get(m["kinds"], F.lit(0)).alias("event_type"), time.alias("log_time"), F.get(m["twice"], F.lit(1)).alias("twice"))


@query("""WITH RECURSIVE n AS (SELECT c_mktsegment AS source, count(*) AS n, row_number() OVER (ORDER BY c_mktsegment) AS k FROM customer GROUP BY 1),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS start UNION ALL
SELECT n.k, least(greatest(f.a, f.b), least(f.a, f.b) + (CAST(n.n AS DOUBLE) + 1.0) / n.n), greatest(greatest(f.a, f.b), least(f.a, f.b) + (CAST(n.n AS DOUBLE) + 1.0) / n.n), least(f.a, f.b) FROM f JOIN n ON n.k = f.k + 1),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer)
SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY f.start + CAST(r AS DOUBLE) / n.n, n.k, r) - 1 AS mix_pos FROM r JOIN n ON n.source = c_mktsegment JOIN f ON f.k = n.k""")
def l14_active_mix(spark, sf_dir):
    # Five segments, two of them open at a time.
    return sharding.active_mix(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"], 2)


#: Every 97th event has no ratio, events of the type error whose value is over 90 no unit; every 13th user has no metadata.
_FAILED = """WITH e AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'no ratio' WHEN event_type = 'error' AND value > 90 THEN 'no unit' END AS reason FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM e),
b AS (SELECT user_id, min(r) FILTER (reason IS NOT NULL) AS bad, count(*) AS n, arg_min(reason, r) FILTER (reason IS NOT NULL) AS why, user_id % 13 = 0 AS skip FROM o GROUP BY 1)
"""


def _with_failures(spark, sf_dir):
    ratio = F.when(F.try_divide(F.lit(1), F.pmod("event_id", F.lit(97))).isNull(), F.lit("no ratio"))
    unit = F.when((F.col("event_type") == "error") & (F.col("value") > 90), F.lit("no unit"))
    skip = F.when(F.try_divide(F.lit(1), F.pmod(F.first("user_id"), F.lit(13))).isNull(), F.lit("no metadata"))
    return store.packaged_with_failures(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.coalesce(ratio, unit), skip)


@query(_FAILED + """, x AS (SELECT user_id, CASE WHEN bad IS NULL THEN n ELSE bad - 1 END AS frame_num, row_number() OVER (ORDER BY user_id) - 1 AS episode_index FROM b WHERE NOT skip)
SELECT o.event_id, x.episode_index, o.r - 1 AS frame_index, row_number() OVER (ORDER BY x.episode_index, o.r) - 1 AS "index" FROM o JOIN x ON x.user_id = o.user_id AND o.r <= x.frame_num""")
def s6_frames_before_failures(spark, sf_dir):
    return _with_failures(spark, sf_dir)["frames"].select("event_id", "episode_index", "frame_index", "index")


@query(_FAILED + """SELECT user_id, CASE WHEN skip THEN 'episode' ELSE 'frame' END AS kind, CASE WHEN skip THEN 'no metadata' ELSE why END AS reason, CAST(CASE WHEN skip THEN 0 ELSE bad - 1 END AS BIGINT) AS kept, CAST(CASE WHEN skip THEN n ELSE n - bad + 1 END AS BIGINT) AS lost FROM b WHERE skip OR bad IS NOT NULL""")
def s6_quarantine(spark, sf_dir):
    return _with_failures(spark, sf_dir)["quarantine"].drop("at")


@query("""SELECT user_id, topic, first, n FROM (SELECT user_id, event_type AS topic, min(event_id) AS first, count(*) AS n FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events) GROUP BY user_id, event_type, run)""")
def x7_converter_function(spark, sf_dir):
    def step(state, row):
        done = run(state) if state.get("topic") not in (None, row["topic"]) else []
        if done or not state:
            state |= {"user": row["user_id"], "topic": row["topic"], "first": row["event_id"], "n": 0}
        state["n"] += 1
        return done

    def run(state):
        return [(state["user"], state["topic"], state["first"], state["n"])] if state else []

    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("topic"), "event_id")
    return tables.converted(rows, ["user_id"], ["event_id"], tables.converter(dict, step, run, "user_id long, topic string, first long, n long"))


@query("""WITH f AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT a.event_id, a.i AS "index", h.value AS half, d.value AS double FROM f a LEFT JOIN f h ON h.i = a.i // 2 LEFT JOIN f d ON d.i = a.i * 2""")
def x3_row_sampler(spark, sf_dir):
    from kinetrail.tables import positions

    frames = positions(read(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], "index")
    choose = tables.sampler(lambda row: {"value": [row["index"] // 2, row["index"] * 2]})
    got = tables.sampled(frames, frames.select("event_id", "index"), ["value"], choose)
    return got.select("event_id", "index", F.get("value", F.lit(0)).alias("half"), F.get("value", F.lit(1)).alias("double"))


#: Two arms on a base: a turning one of two links, as long as the robot's number says, and a sliding one with a finger that follows it.
_ARMS = """<robot name="r"><link name="base"/><link name="upper"/><link name="lower"/><link name="tip"/><link name="slide"/><link name="finger"/>
<joint name="shoulder" type="revolute"><parent link="base"/><child link="upper"/><origin xyz="0 0 0.5"/><axis xyz="0 0 1"/></joint>
<joint name="elbow" type="continuous"><parent link="upper"/><child link="lower"/><origin xyz="{0} 0 0"/><axis xyz="0 0 1"/></joint>
<joint name="hand" type="fixed"><parent link="lower"/><child link="tip"/><origin xyz="0.25 0 0"/></joint>
<joint name="rail" type="prismatic"><parent link="base"/><child link="slide"/><axis xyz="0 1 0"/></joint>
<joint name="grip" type="prismatic"><parent link="slide"/><child link="finger"/><axis xyz="0 0 1"/><mimic joint="rail" multiplier="-0.5" offset="1"/></joint></robot>"""


@query("""SELECT c_custkey, round((n + 1) * cos(a) + 0.25 * cos(3 * a), 6) AS tip_x, round((n + 1) * sin(a) + 0.25 * sin(3 * a), 6) AS tip_y, round(a / 4, 6) AS finger_y, round(1 - a / 8, 6) AS finger_z, 2 AS apart
FROM (SELECT c_custkey, c_nationkey AS n, CAST(c_acctbal AS DOUBLE) / 7001 AS a FROM customer)""")
def c18_robot_descriptions(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("robot"), (F.col("c_acctbal").cast("double") / 7001).alias("a"))
    parts = _ARMS.split("{0}")
    described = customers.select("robot").distinct().withColumn("text", F.concat(F.lit(parts[0]), (F.col("robot").cast("int") + 1).cast("string"), F.lit(parts[1])))
    joints = robots.joint_table(described, "robot", "text")
    state = F.create_map(F.lit("shoulder"), F.col("a"), F.lit("elbow"), F.col("a") * 2, F.lit("rail"), F.col("a") / 4)
    posed = customers.withColumn("p", robots.link_poses(joints, "robot", state, ["tip", "finger"]))
    # The elbow and the rail: one joint apart on the base, and one along the arm.
    apart = robots.joint_distances(joints).where("a = 'elbow' and b = 'rail'").select(F.col("robot").alias("_robot"), F.col("distance").alias("apart"))
    at = lambda link, k: F.get(F.col("p")[link], F.lit(k))
    got = posed.join(apart, F.col("robot") == F.col("_robot")).select("c_custkey", at("tip", 3).alias("tip_x"), at("tip", 7).alias("tip_y"), at("finger", 7).alias("finger_y"), at("finger", 11).alias("finger_z"), "apart")
    return got.select("c_custkey", *rounded("tip_x", "tip_y", "finger_y", "finger_z"), "apart")


@query("""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, least(greatest(2 + 4 * CAST(unnest(embedding) AS DOUBLE), 0.5), 4.0) AS d FROM embeddings),
b AS (SELECT vec_id, (k // 8) // 2 * 4 + k % 8 // 2 AS cell, least(floor((d - 0.5) / 3.5 * 7), 6) AS low, (d - 0.5) / 3.5 * 7 AS place FROM p),
w AS (SELECT vec_id, cell, low AS bin, 1 - (place - low) AS w FROM b UNION ALL SELECT vec_id, cell, low + 1, place - low FROM b)
SELECT vec_id, cell, CAST(bin AS BIGINT) AS bin, round(sum(w) / 4, 6) AS share FROM w GROUP BY 1, 2, 3 HAVING round(sum(w) / 4, 6) > 0""")
def c32_depth_bins(spark, sf_dir):
    # Vectors as 8 x 8 depth images.
    images = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: 2 + 4 * x.cast("double")).alias("depths"))
    cells = images.select("vec_id", F.posexplode(depths.bin_labels("depths", 8, 8, (2,), 8, 0.5, 4.0)).alias("cell", "shares"))
    got = cells.select("vec_id", F.col("cell").cast("long").alias("cell"), F.posexplode("shares").alias("bin", "share"))
    return got.select("vec_id", "cell", F.col("bin").cast("long").alias("bin"), F.round("share", 6).alias("share")).where("share > 0")


@query("""WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS bytes FROM documents), l AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT doc_id, bytes, CAST(before // (40000 - (SELECT max(bytes) FROM s WHERE bytes <= 20000)) AS BIGINT) AS shard FROM l""")
def s5_byte_shards(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return sharding.byte_shards(rows, 40_000, ["doc_id"]).select("doc_id", "bytes", "shard")


@query("""SELECT l_orderkey, round(sum(l_quantity * l_tax), 4) AS total FROM lineitem GROUP BY 1""")
def s1_arrow_files(spark, sf_dir):
    # Written as Arrow files, three columns read back.
    arrow_source.register(spark)
    at = f"{shared_dir(spark).rstrip('/')}/kinetrail/arrow-{uuid4().hex}"
    rows = read(spark, sf_dir, "lineitem")
    rows.write.format("arrowfile").mode("append").save(at)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("l_orderkey", "l_quantity", "l_tax"))
    got = spark.read.format("arrowfile").schema(kinds).load(at)
    return got.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_tax")), 4).alias("total"))


@query("""SELECT event_id, value AS elbow, CASE WHEN event_type = 'error' THEN NULL ELSE value * 2 END AS wrist FROM events""")
def s13_joint_messages(spark, sf_dir):
    # To messages and back; errors have no wrist, and names come in another order than is asked for.
    rows = read(spark, sf_dir, "events").withColumn("_bad", F.col("event_type") == "error")
    names = F.when(F.col("_bad"), F.array(F.lit("elbow"))).otherwise(F.array(F.lit("wrist"), F.lit("elbow")))
    place = F.when(F.col("_bad"), F.array("value")).otherwise(F.array(F.col("value") * 2, F.col("value")))
    sent = imports.joint_messages(rows.select("event_id", names.alias("names"), place.alias("position")), "/joints", ["event_id"])
    got = imports.joints_of(sent, "/joints", ["event_id"], ["elbow", "wrist"])
    return got.select("event_id", F.get("position", F.lit(0)).alias("elbow"), F.get("position", F.lit(1)).alias("wrist"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY kind, turn, text, part) - 1 AS idx, topic, turn AS log_time, data FROM (
SELECT conv_id, turn, coalesce(text, '') AS text, 0 AS part, CASE role WHEN 'user' THEN 1 ELSE 2 END AS kind, CASE role WHEN 'user' THEN 'user' ELSE 'said' END AS topic, coalesce(text, '') AS data FROM conversations
UNION ALL SELECT conv_id, turn, coalesce(text, ''), 1, 2, 'length', CAST(length(coalesce(text, '')) AS VARCHAR) FROM conversations WHERE role IS DISTINCT FROM 'user')""")
def s12_dict_records(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    message = F.struct(F.col("turn").cast("long").alias("log_time"), F.col("text").alias("data"))
    own = F.coalesce(F.col("role") == "user", F.lit(False))
    logs = rows.groupBy("conv_id").agg(*[F.array_sort(F.collect_list(F.when(c, message))).alias(n) for n, c in (("user", own), ("other", ~own))])
    got = assembly.dict_records(logs, ["conv_id"], {"user": None, "other": {"said": lambda d: d, "length": F.length}})
    return got.select("conv_id", "idx", "topic", "log_time", "data")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, s.s_nationkey AS nation, CASE WHEN s.s_nationkey % 2 = 0 THEN s.s_nationkey ELSE l_quantity * 2 END AS shift
FROM lineitem JOIN supplier s ON s.s_suppkey = l_suppkey""")
def p17_camera_rows(spark, sf_dir):
    # Suppliers as recordings with one camera, that of every other one moving by the lines' quantities.
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumnsRenamed({"l_suppkey": "recording", "l_quantity": "step"})
    known = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("recording"), F.concat(F.lit("cam"), "s_nationkey").alias("camera"), F.col("s_nationkey").cast("double").alias("n"))
    by = lambda x: F.array(*[F.lit(float(k in (0, 5, 10))) if k != 3 else x for k in range(12)])
    cameras = known.select("recording", "camera", F.array(*[F.col("n") if k == 0 else F.lit(0.0) for k in range(9)]).alias("intrinsic"), F.when(F.col("n") % 2 == 0, by(F.col("n"))).alias("world_to_camera"))
    moving = lines.select("recording", "step").distinct().join(known.where("n % 2 = 1").select("recording", "camera"), "recording").select("recording", "camera", "step", by(F.col("step").cast("double") * 2).alias("world_to_camera"))
    got = assembly.camera_rows(lines, cameras, moving, "recording", "step").withColumn("c", F.get("cameras", F.lit(0)))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", F.col("recording").alias("l_suppkey"), F.col("step").alias("l_quantity"), F.get("c.intrinsic", F.lit(0)).cast("int").alias("nation"), F.get("c.world_to_camera", F.lit(3)).alias("shift"))


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), c AS (SELECT vec_id, e, abs(e[7]) AS s1, abs(e[8]) AS s2, abs(e[9]) AS s3, abs(e[10]) AS t1, abs(e[11]) AS t2, abs(e[12]) AS t3, cos(e[13]) AS c, sin(e[13]) AS s FROM e)
SELECT vec_id, round(sqrt((e[1] - e[4]) ** 2 + (e[2] - e[5]) ** 2 + (e[3] - e[6]) ** 2 + (s1 * c * c + s2 * s * s - t1) ** 2 + 2 * ((s1 - s2) * s * c) ** 2 + (s1 * s * s + s2 * c * c - t2) ** 2 + (s3 - t3) ** 2), 6) AS apart FROM c""")
def c37_turned_boxes(spark, sf_dir):
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(13)]
    zero = F.lit(0.0)
    turned, straight = geometry.euler_matrix([e[12], zero, zero]), geometry.euler_matrix([zero, zero, zero])
    d = geometry.box_wasserstein(e[:3], [F.abs(x) for x in e[6:9]], turned, e[3:6], [F.abs(x) for x in e[9:12]], straight)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(d, 6).alias("apart"))


@query("""SELECT doc_id, len(string_split(source, 'e')) - 1 = 0 AS is_unique, len(string_split(source, 'e')) - 1 > 3 AS is_hard, len(list_intersect(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), ['front', 'behind', 'back', 'left', 'right', 'facing', 'leftmost', 'rightmost', 'looking', 'across'])) > 0 AS is_view_dep FROM documents""")
def s21_grounding_flags(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", F.slice(F.split("source", "e"), 2, 1000).alias("distractor_ids"))
    return assembly.grounding_flags(rows).select("doc_id", "is_unique", "is_hard", "is_view_dep")


@query("""SELECT event_id, round(coalesce(lag(value) OVER w, value), 6) AS before, round(value * 2, 6) AS now, round(coalesce(lead(value) OVER w, value) + 1, 6) AS ahead,
episode_index + 1 AS focal, -(CAST(episode_index AS DOUBLE) + 1) AS x, round(value + 1, 6) AS y, -1.0 AS z, CASE WHEN frame_index % 2 = 1 THEN round((value + 7) / 1000, 6) ELSE 0.0 END AS depth,
event_type AS text, 'u' || user_id AS uuid, frame_index AS step_index, 1 AS step_index_in_chunk FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""")
def p15_parsed_rows(spark, sf_dir):
    # Two steps back and one ahead, a camera that is turned a quarter and moved, depths of two pixels at odd steps.
    rows = temporal.chunk(frames_of(spark, sf_dir).withColumn("now", F.col("value")), ["value"], 2, 1)
    number = lambda c: F.col(c).cast("double")
    pose = F.array(*map(F.lit, (0.0, -1.0, 0.0)), number("now") + 1, *map(F.lit, (1.0, 0.0, 0.0)), number("episode_index") + 1, *map(F.lit, (0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)))
    camera = F.struct(
        F.lit("lens").alias("frame_id"),
        F.array(*[number("episode_index") + 1 if k in (0, 4) else F.lit(float(k == 8)) for k in range(9)]).alias("intrinsic"),
        F.struct(F.lit("world").alias("parent"), F.lit("lens").alias("child"), pose.alias("matrix")).alias("pose"),
        F.lit(1).alias("height"),
        F.lit(2).alias("width"),
    )
    rows = rows.select(
        "event_id",
        "frame_index",
        F.transform(F.slice("value", 1, 2), lambda v: F.array(v, v * 2)).alias("joints"),
        F.transform(F.slice("value", 3, 1), lambda v: F.array(v + 1)).alias("actions"),
        F.to_json(F.struct(F.col("event_type").alias("description"))).alias("instruction"),
        F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("uuid"))).alias("info"),
        camera.alias("top"),
        F.when(F.col("frame_index") % 2 == 1, F.array(F.lit(3.0), number("now") + 4)).alias("top_depth"),
    )
    got = assembly.parsed_rows(rows, ["top"], hist_steps=2)
    at = lambda name, *places: F.col(name).getItem(places[0]) if len(places) == 1 else F.col(name).getItem(places[0]).getItem(places[1])
    total = F.aggregate(at("depths", 0), F.lit(0.0), lambda a, d: a + d)
    return got.select(
        "event_id",
        F.round(at("joint_state", 0, 0), 6).alias("before"),
        F.round(at("joint_state", 1, 1), 6).alias("now"),
        F.round(at("master_joint_state", 0, 0), 6).alias("ahead"),
        at("intrinsic", 0, 5).cast("long").alias("focal"),
        at("world_to_camera", 0, 3).alias("x"),
        F.round(at("world_to_camera", 0, 7), 6).alias("y"),
        at("world_to_camera", 0, 11).alias("z"),
        F.round(total, 6).alias("depth"),
        "text",
        "uuid",
        "step_index",
        "step_index_in_chunk",
    )
