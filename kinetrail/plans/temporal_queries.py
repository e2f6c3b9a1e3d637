"""Queries of the temporal operators over events as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.operators import filters, sequences, temporal
from kinetrail.plans.registry import frames_of, query, rounded
from kinetrail.tables import read

HOUR = 3600


@query('SELECT "index", episode_index, frame_index, timestamp_min, event_id FROM frames')
def frames_index(spark, sf_dir):
    return frames_of(spark, sf_dir).select("index", "episode_index", "frame_index", "timestamp_min", "event_id")


@query("""SELECT "index", lag(value) OVER w AS v0, value AS v1, lead(value, 2) OVER w AS v2, lag(event_id, 3) OVER w AS e0
FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY "index")""")
def w1_offset_window(spark, sf_dir):
    got = temporal.offset_window(frames_of(spark, sf_dir).select("index", "episode_index", F.col("value"), "event_id"), {"value": [-1, 0, 2, None], "event_id": [-3]})
    return got.select("index", *[F.get("value", F.lit(k)).alias(f"v{k}") for k in range(3)], F.get("event_id", F.lit(0)).alias("e0"))


@query("""SELECT a."index", b.value AS before, c.value AS after FROM frames a
LEFT JOIN frames b ON b."index" = a."index" - 5 LEFT JOIN frames c ON c."index" = a."index" + 7""")
def j5_offset_across_episodes(spark, sf_dir):
    got = temporal.offset_join(frames_of(spark, sf_dir), "value", F.array(F.lit(-5), F.lit(7)))
    return got.select("index", F.get("value", F.lit(0)).alias("before"), F.get("value", F.lit(1)).alias("after"))


@query("""SELECT a."index", b.value AS moved FROM frames a
LEFT JOIN frames b ON b."index" = a."index" + a.event_id % 4 AND b.episode_index = a.episode_index""")
def w3_custom_offsets(spark, sf_dir):
    got = temporal.offset_join(frames_of(spark, sf_dir), "value", F.array((F.col("event_id") % 4).cast("int")), True)
    return got.select("index", F.get("value", F.lit(0)).alias("moved"))


@query("""SELECT "index", arg_max(value, timestamp_min) OVER b AS v0, value AS v1, arg_min(value, timestamp_min) OVER a AS v2 FROM frames
WINDOW a AS (PARTITION BY episode_index ORDER BY timestamp_min RANGE BETWEEN 10800000000000 FOLLOWING AND 32400000000000 FOLLOWING),
b AS (PARTITION BY episode_index ORDER BY timestamp_min RANGE BETWEEN 32400000000000 PRECEDING AND 10800000000000 PRECEDING)""")
def w2_delta_timestamp_window(spark, sf_dir):
    got = temporal.delta_window(frames_of(spark, sf_dir).select("index", "episode_index", "timestamp_min", "value"), {"value": [-6 * HOUR, 0, 6 * HOUR]}, 3 * HOUR)
    return got.select("index", *[F.get("value", F.lit(k)).alias(f"v{k}") for k in range(3)])


@query("""SELECT a."index", arg_min(b.event_id, (b.timestamp_min, b."index")) AS event_id FROM frames a LEFT JOIN frames b
ON a.episode_index = b.episode_index AND b.timestamp_min <= a.timestamp_max + 3600000000000 + 32400000000000
AND b.timestamp_max + 3600000000000 >= a.timestamp_min + 10800000000000 GROUP BY a."index" """)
def j6_delta_interval_join(spark, sf_dir):
    """Frames that last an hour."""
    lasting = frames_of(spark, sf_dir).select("index", "episode_index", "timestamp_min", (F.col("timestamp_max") + HOUR * 10**9).alias("timestamp_max"), "event_id")
    return temporal.delta_join(lasting, "event_id", 6 * HOUR, 3 * HOUR, 6 * HOUR * 10**9).select("index", "event_id")


@query("""SELECT a."index", b0.value AS v0, a.value AS v1, b2.value AS v2, b3.value AS v3, b4.value AS v4 FROM frames a
JOIN (SELECT episode_index AS e, count(*) AS n FROM frames GROUP BY 1) s ON s.e = a.episode_index
JOIN frames b0 ON b0.episode_index = a.episode_index AND b0.frame_index = greatest(a.frame_index - 1, 0)
JOIN frames b2 ON b2.episode_index = a.episode_index AND b2.frame_index = least(a.frame_index + 2, n - 1)
JOIN frames b3 ON b3.episode_index = a.episode_index AND b3.frame_index = least(a.frame_index + 4, n - 1)
JOIN frames b4 ON b4.episode_index = a.episode_index AND b4.frame_index = least(a.frame_index + 6, n - 1)""")
def w4_episode_chunk(spark, sf_dir):
    got = temporal.chunk(frames_of(spark, sf_dir).select("index", "episode_index", "value"), ["value"], 2, 3, 2)
    return got.select("index", *[F.get("value", F.lit(k)).alias(f"v{k}") for k in range(5)])


@query("""SELECT c.conv_id, c.turn, g.texts FROM conversations c
JOIN (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS texts FROM conversations GROUP BY 1) g ON g.conv_id = c.conv_id""")
def w5_episode_gather(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("at"), "text")
    got = temporal.gather(rows, ["text"], "at", "conv_id")
    return got.select("conv_id", "turn", F.array_join("text", "|").alias("texts"))


@query("""SELECT episode_index, coalesce(v0, v1, v2) AS p0, CASE WHEN v1 IS NOT NULL THEN v1 WHEN v0 IS NULL THEN v2 WHEN v2 IS NULL THEN v0 END AS p1,
coalesce(v2, v1, v0) AS p2, "index" FROM (SELECT *, lag(u) OVER w AS v0, u AS v1, lead(u) OVER w AS v2 FROM
(SELECT *, CASE WHEN value > 5 THEN value END AS u FROM frames) WINDOW w AS (PARTITION BY episode_index ORDER BY "index"))""")
def w7_pad_list(spark, sf_dir):
    rows = frames_of(spark, sf_dir).select("index", "episode_index", F.when(F.col("value") > 5, F.col("value")).alias("u"))
    got = temporal.offset_window(rows, {"u": [-1, 0, 1]}).withColumn("u", sequences.pad_ends(F.col("u")))
    return got.select("episode_index", *[F.get("u", F.lit(k)).alias(f"p{k}") for k in range(3)], "index")


@query("""SELECT b.event_id, arg_min(m.event_id, (abs(m.t - b.t), m.t)) AS nearest, min(abs(m.t - b.t)) AS apart
FROM (SELECT user_id, event_id, epoch_ns(ts) AS t FROM events WHERE event_type = 'view') b
JOIN (SELECT user_id, event_id, epoch_ns(ts) AS t FROM events WHERE event_type = 'click') m ON m.user_id = b.user_id GROUP BY b.event_id""")
def j8_nearest_sync(spark, sf_dir):
    from kinetrail.plans.registry import nanoseconds_of

    events = read(spark, sf_dir, "events").withColumn("log_time", nanoseconds_of())
    base = events.where("event_type = 'view'").select("user_id", "event_id", "log_time")
    stream = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("nearest"), "log_time")
    return temporal.nearest(base, stream, "nearest", ["user_id"]).where("nearest is not null").select("event_id", "nearest", "apart")


@query("""SELECT "index" FROM (SELECT *, value - lag(value) OVER (PARTITION BY episode_index ORDER BY "index") AS d FROM frames) WHERE d IS NULL OR abs(d) > 10""")
def f5_moving_frames(spark, sf_dir):
    return temporal.moving_frames(frames_of(spark, sf_dir), "value", 10).select("index")


@query("""SELECT "index" FROM (SELECT *, value - lag(value) OVER (PARTITION BY episode_index ORDER BY "index") AS d,
min(timestamp_min) OVER (PARTITION BY episode_index) AS lo, max(timestamp_min) OVER (PARTITION BY episode_index) AS hi FROM frames)
WHERE d IS NULL OR abs(d) > 10 OR NOT (timestamp_min - lo <= 172800000000000 OR hi - timestamp_min <= 86400000000000)""")
def f5_moving_or_inside(spark, sf_dir):
    return temporal.moving_frames(frames_of(spark, sf_dir), "value", 10, 48 * HOUR, 24 * HOUR).select("index")


@query("""SELECT "index", coalesce(abs(value - lag(value) OVER (PARTITION BY episode_index ORDER BY "index")) < 10, true) AS static FROM frames""")
def f6_static_mask(spark, sf_dir):
    return temporal.static_mask(frames_of(spark, sf_dir), "value", 10).select("index", "static")


@query("""SELECT "index", round(value - lag(value) OVER (PARTITION BY episode_index ORDER BY "index"), 6) AS change FROM frames""")
def w12_differences(spark, sf_dir):
    return temporal.changes(frames_of(spark, sf_dir), "value").select("index", *rounded("change"))


@query("""SELECT vec_id, round(h.a, 6) AS a, round(h.b, 6) AS b, round(h.c, 6) AS c FROM (SELECT vec_id,
{'a': embedding[1], 'b': embedding[16] + (embedding[17] - embedding[16]) * 0.75, 'c': embedding[64]} AS h FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings))""")
def w8_upsample(spark, sf_dir):
    """64 steps to 13, which are 5.25 apart: the first, fourth and last."""
    wide = sequences.linear(F.col("embedding").cast("array<double>"), 13)
    got = read(spark, sf_dir, "embeddings").select("vec_id", wide.alias("s"))
    return got.select("vec_id", *[F.round(F.get("s", F.lit(k)), 6).alias(n) for k, n in ((0, "a"), (3, "b"), (12, "c"))])


@query("""SELECT vec_id, CAST(n AS BIGINT) AS n, round(e[1], 6) AS a, round(e[4], 6) AS b, round(e[64], 6) AS c, round(e[1] + e[5] + e[9], 6) AS d FROM
(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, floor(64 / 1.5) AS n FROM embeddings)""")
def w9_resample(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    got = read(spark, sf_dir, "embeddings").select("vec_id", sequences.resample(e, 1.5).alias("s"), sequences.resample(e, 4).alias("q"), e.alias("e"))
    return got.select(
        "vec_id", F.size("s").cast("long").alias("n"), F.round(F.get("s", F.lit(0)), 6).alias("a"), F.round(F.get("e", F.lit(3)), 6).alias("b"),
        F.round(F.get("s", F.size("s") - 1), 6).alias("c"), F.round(F.get("q", F.lit(0)) + F.get("q", F.lit(1)) + F.get("q", F.lit(2)), 6).alias("d"),
    )


@query("""SELECT vec_id, k - 1 AS k, round(e[k] - e[1], 6) AS change FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), range(1, 65) t(k)""")
def w10_delta_state(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    got = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sequences.delta(e, F.slice(e, 1, 1))).alias("k", "change"))
    return got.select("vec_id", F.col("k").cast("long").alias("k"), *rounded("change"))


@query("""SELECT "index", h0.value AS h0, p1.value AS p1, a.frame_index + 2 <= n - 1 AS real FROM frames a
JOIN (SELECT episode_index AS e, count(*) AS n FROM frames GROUP BY 1) s ON s.e = a.episode_index
JOIN (SELECT episode_index AS eh, frame_index AS fh, value FROM frames) h0 ON eh = a.episode_index AND fh = greatest(a.frame_index - 2, 0)
JOIN (SELECT episode_index AS ep, frame_index AS fp, value FROM frames) p1 ON ep = a.episode_index AND fp = least(a.frame_index + 2, n - 1)""")
def w6_state_sampling(spark, sf_dir):
    got = temporal.sampled_states(frames_of(spark, sf_dir).select("index", "episode_index", "value"), ["value"], 3, 2)
    p1 = F.get("value_pred", F.lit(1))
    return got.select("index", F.get("value_hist", F.lit(0)).alias("h0"), p1["value"].alias("p1"), p1["real"].alias("real"))


@query("""SELECT "index" FROM frames f WHERE episode_index % 2 = 1 OR frame_index BETWEEN 2 AND 9 OR frame_index BETWEEN 20 AND 29""")
def f7_span_mask(spark, sf_dir):
    rows = frames_of(spark, sf_dir)
    even = rows.select("episode_index").distinct().where("episode_index % 2 = 0")
    spans = even.select("episode_index", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((2, 10), (20, 30))])).alias("s")).select("episode_index", "s.*")
    return filters.in_spans(rows, spans, ["episode_index"]).select("index")
