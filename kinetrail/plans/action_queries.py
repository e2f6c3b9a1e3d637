"""Queries of action tokens, kinematics and repacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.functions import codecs, geometry
from kinetrail.operators import algebra
from kinetrail.plans.registry import dataset, query, rounded
from kinetrail.tables import read


@query("""SELECT vec_id, '<arm>' || array_to_string(list_transform(list_filter(range(64), lambda i: i % 8 < 7), lambda i: chr(33 + CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 1000) AS INTEGER))), '')
|| '<gripper>' || array_to_string(list_transform(list_filter(range(64), lambda i: i % 8 = 7), lambda i: chr(33 + CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 1000) AS INTEGER))), '') AS text, true AS comes_back FROM embeddings""")
def c11_action_text(spark, sf_dir):
    token = lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("int") + 33
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.slice("embedding", k * 8 + 1, 8), token))
    got = read(spark, sf_dir, "embeddings").select("vec_id", steps.alias("steps")).withColumn("text", codecs.action_text(F.col("steps"), 1))
    return got.select("vec_id", "text", F.col("steps").eqNullSafe(codecs.from_action_text(F.col("text"), 8, 1)).alias("comes_back"))


@query("""SELECT event_id, round(cos(a) + 0.5 * cos(a + b) + 0.25 * cos(a + b + c), 6) AS x, round(sin(a) + 0.5 * sin(a + b) + 0.25 * sin(a + b + c), 6) AS y, round(0.1 + value / 50, 6) AS z
FROM (SELECT event_id, value, value / 10 AS a, value / 20 AS b, value / 30 AS c FROM events)""")
def c18_link_poses(spark, sf_dir):
    def out(length):
        return (1.0, 0.0, 0.0, length, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)

    lift = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.1, 0.0, 0.0, 0.0, 1.0)
    chain = [geometry.Joint(lift, kind="slide"), geometry.Joint(), geometry.Joint(out(1.0)), geometry.Joint(out(0.5)), geometry.Joint(out(0.25), kind="fixed")]
    values = F.array(*[F.col("value") / n for n in (50, 10, 20, 30)])
    tip = read(spark, sf_dir, "events").select("event_id", F.element_at(geometry.link_poses(chain, values), -1).alias("tip"))
    return tip.select("event_id", F.get("tip", F.lit(3)).alias("x"), F.get("tip", F.lit(7)).alias("y"), F.get("tip", F.lit(11)).alias("z")).select("event_id", *rounded("x", "y", "z"))


@query("""SELECT row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS "index", dense_rank() OVER (ORDER BY episode_index) - 1 AS episode_index,
row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS frame_index, timestamp_min, timestamp_max, event_type FROM frames WHERE value > 5""")
def p13_repack_columns(spark, sf_dir):
    parts = dataset(spark, sf_dir)
    e = parts["episodes"].withColumns({"prev_episode_index": F.lit(None).cast("long"), "truncated": F.lit(False), "success": F.lit(True), "info": F.lit("{}")})
    return algebra.repacked(parts["frames"], e, parts["frames"].where("value > 5").select("index"), ["event_type"])[0]


@query("""WITH firsts AS (SELECT user_id, event_type, event_id FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1
UNION ALL SELECT user_id, event_type, event_id FROM events WHERE event_type = 'view')
SELECT user_id, string_agg(event_type, '. ' ORDER BY event_id) AS text, count(*) AS n, CAST(sum(length(event_type)) + 2 * (count(*) - 1) AS BIGINT) AS last_end FROM firsts GROUP BY 1""")
def u8_distinct_targets(spark, sf_dir):
    # Views name no target, so all of them stay.
    rows = read(spark, sf_dir, "events").withColumn("target", F.when(F.col("event_type") != "view", F.col("event_type")))
    got = algebra.merged_texts(rows, ["user_id"], "event_id", "event_type", ". ", "target")
    return got.select("user_id", "text", F.size("spans").cast("long").alias("n"), F.get("spans", F.size("spans") - 1)["end"].cast("long").alias("last_end"))
