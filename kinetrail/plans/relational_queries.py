"""Queries of projections, filters, lookups, dataset algebra and sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.functions import codecs, geometry, scalars
from kinetrail.operators import algebra, filters, lookups, metrics, sharding
from kinetrail.plans.registry import dataset, frames_of, query, rounded
from kinetrail.tables import positions, read


@query("""SELECT episode_index, min("index") AS dataset_begin_index, count(*) AS frame_num FROM frames GROUP BY 1""")
def g28_episode_dim(spark, sf_dir):
    return dataset(spark, sf_dir)["episodes"].select("episode_index", "dataset_begin_index", "frame_num")


@query("""SELECT a."index" AS pos, b."index", b.value FROM frames a JOIN frames b ON b."index" = a."index" * 7 % (SELECT count(*) FROM events)""")
def p3_select_by_index(spark, sf_dir):
    frames = frames_of(spark, sf_dir)
    asked = frames.select(F.col("index").alias("pos"), (F.col("index") * 7 % read(spark, sf_dir, "events").count()).alias("index"))
    return asked.join(frames, "index").select("pos", "index", "value")


@query("""SELECT "index", episode_index, value AS reading FROM frames""")
def p2_rename_project(spark, sf_dir):
    from kinetrail.dataset import TrajectoryDataset

    parts = dataset(spark, sf_dir)
    got = TrajectoryDataset(parts["frames"], parts["episodes"]).rename_columns({"value": "reading"}).select_columns(["index", "episode_index", "reading"], False)
    return got.frames


@query("""SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' AND l_quantity > 30 GROUP BY 1, 2, 3""")
def f1_composite_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "episode_index")
    orders = read(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "episode_index", "o_custkey": "task_index"})
    customers = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "task_index")
    got = filters.composite(rows, orders, tasks=customers, episode=F.col("o_orderstatus") == "F", task=F.col("c_mktsegment") == "BUILDING", row=F.col("l_quantity") > 30)
    return got.groupBy(F.col("episode_index").alias("l_orderkey"), "l_linenumber", "l_quantity").agg(F.count("*").alias("n"))


@query("""SELECT l_partkey, p_name, p_brand, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""")
def j1_meta_expand(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part_index")
    got = lookups.expanded(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_index"), F.col("l_partkey"), "l_quantity"), {"part": parts})
    return got.groupBy("l_partkey", F.col("part.p_name").alias("p_name"), F.col("part.p_brand").alias("p_brand")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("""SELECT o_orderkey AS pos, o_custkey + o_orderkey % 3 AS key, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey + o_orderkey % 3""")
def j2_batched_fetch(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("key"))
    return lookups.fetched(asked, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name"), "key")


@query("""SELECT a.o_orderkey, b.o_totalprice AS prev_price FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) a
LEFT JOIN orders b ON b.o_orderkey = a.p""")
def j4_previous_episode(spark, sf_dir):
    from pyspark.sql import Window

    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_index"), "o_custkey", "o_orderdate", F.col("o_totalprice").alias("price"))
    linked = orders.withColumn("prev_episode_index", F.lag("episode_index").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "episode_index")))
    return lookups.previous_episode(linked, ["price"]).select(F.col("episode_index").alias("o_orderkey"), "prev_price")


@query("""SELECT pos, part, pos - s AS local FROM (SELECT o_custkey AS part, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM orders GROUP BY 1)
JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) ON pos >= s AND pos < s + n""")
def j9_route_index(spark, sf_dir):
    # Customers end to end by their numbers of orders; every position is sought.
    orders = read(spark, sf_dir, "orders")
    sizes = orders.groupBy(F.col("o_custkey").alias("part")).agg(F.count("*").alias("size"))
    return lookups.routed(positions(orders.select("o_orderkey"), ["o_orderkey"], "pos").select("pos"), sizes)


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, 'override', n_regionkey FROM nation WHERE n_nationkey % 5 = 0""")
def j17_override(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return lookups.overridden(nation, nation.where("n_nationkey % 5 = 0").withColumn("n_name", F.lit("override")), ["n_nationkey"])


@query("""SELECT s_suppkey, s_name, c_custkey FROM supplier JOIN (SELECT min(c_custkey) AS c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey HAVING count(*) = 1) ON c_nationkey = s_nationkey""")
def j12_exactly_one(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return lookups.matched_once(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation")), rich, ["nation"]).select("s_suppkey", "s_name", "c_custkey")


@query("""SELECT event_id, 0 AS dataset_index FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, 1 FROM events WHERE user_id % 2 = 1""")
def u1_concat(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id")
    return algebra.concatenated([events.where("user_id % 2 = 0"), events.where("user_id % 2 = 1")]).select("event_id", "dataset_index")


_DIMS = """rows AS (SELECT user_id % 2 AS d, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, event_id FROM events),
old AS (SELECT d, event_type, k, dense_rank() OVER (PARTITION BY d ORDER BY event_type, k) - 1 AS task_index FROM rows GROUP BY d, event_type, k),
firsts AS (SELECT event_type, k, min((d, task_index)) AS f FROM old GROUP BY event_type, k),
new AS (SELECT event_type, k, row_number() OVER (ORDER BY f) - 1 AS task_index FROM firsts)
"""


def _two(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k"))
    out = []
    for d in (0, 1):
        mine = events.where(F.col("user_id") % 2 == d)
        dim = positions(mine.select("event_type", "k").distinct(), ["event_type", "k"], "task_index")
        out.append((mine.join(dim, ["event_type", "k"]).select("event_id", "task_index"), dim))
    return out


@query("WITH " + _DIMS + "SELECT task_index, event_type, k FROM new")
def u2_merged_tasks(spark, sf_dir):
    return algebra.merged_dimension([dim for _, dim in _two(spark, sf_dir)], "task_index", ["event_type", "k"])[0]


@query("WITH " + _DIMS + "SELECT event_id, new.task_index FROM rows JOIN new USING (event_type, k)")
def j11_merge_remap(spark, sf_dir):
    two = _two(spark, sf_dir)
    _, mapping = algebra.merged_dimension([dim for _, dim in two], "task_index", ["event_type", "k"])
    return algebra.remapped(algebra.concatenated([frames for frames, _ in two]), "task_index", mapping).select("event_id", "task_index")


@query("""SELECT row_number() OVER (ORDER BY d, e) - 1 AS episode_index, d AS dataset_index, frame_num, CASE WHEN e % 7 = 0 THEN -1 ELSE b + CASE WHEN d = 1 THEN t ELSE 0 END END AS dataset_begin_index,
CASE WHEN e % 3 = 1 THEN row_number() OVER (ORDER BY d, e) - 2 END AS prev_episode_index FROM (SELECT user_id % 2 AS d, dense_rank() OVER (PARTITION BY user_id % 2 ORDER BY user_id) - 1 AS e, n AS frame_num,
coalesce(sum(n) OVER (PARTITION BY user_id % 2 ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(CASE WHEN user_id % 2 = 0 THEN n END) OVER () AS t
FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1))""")
def u2_merged_episodes(spark, sf_dir):
    sizes = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frame_num"))
    sets = []
    for d in (0, 1):
        e = positions(sizes.where(F.col("user_id") % 2 == d), ["user_id"], "episode_index", "frame_num", "dataset_begin_index")
        link = F.when(F.col("episode_index") % 3 == 1, F.col("episode_index") - 1)
        begin = F.when(F.col("episode_index") % 7 == 0, F.lit(-1)).otherwise(F.col("dataset_begin_index")).cast("long")
        sets.append(e.select("episode_index", "frame_num", begin.alias("dataset_begin_index"), link.alias("prev_episode_index")))
    return algebra.merged_episodes(sets)[0].select("episode_index", F.col("dataset_index").cast("long").alias("dataset_index"), "frame_num", "dataset_begin_index", "prev_episode_index")


@query(""", kept AS (SELECT * FROM frames WHERE episode_index % 3 <> 0 AND (episode_index % 3 = 1 OR value > 5)),
n AS (SELECT episode_index, count(*) AS n FROM kept GROUP BY 1), full_n AS (SELECT episode_index, count(*) AS m FROM frames GROUP BY 1),
e AS (SELECT episode_index AS old, row_number() OVER (ORDER BY episode_index) - 1 AS episode_index, n AS frame_num, n = m AS whole,
CAST(coalesce(sum(n) OVER (ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dataset_begin_index FROM n JOIN full_n USING (episode_index))
SELECT e.episode_index, CASE WHEN e.whole AND p.whole THEN p.episode_index END AS prev_episode_index, e.dataset_begin_index, e.frame_num, CASE WHEN e.whole THEN e.old % 2 = 0 END AS success
FROM e LEFT JOIN e p ON p.old = e.old - 3 -- frames""")
def u4_repack_episodes(spark, sf_dir):
    return _repacked(spark, sf_dir)[1].select("episode_index", "prev_episode_index", "dataset_begin_index", "frame_num", "success")


@query("""SELECT row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS "index", dense_rank() OVER (ORDER BY episode_index) - 1 AS episode_index,
row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS frame_index, event_id FROM frames WHERE episode_index % 3 <> 0 AND (episode_index % 3 = 1 OR value > 5)""")
def u4_repack_frames(spark, sf_dir):
    return _repacked(spark, sf_dir)[0].select("index", "episode_index", "frame_index", "event_id")


def _repacked(spark, sf_dir):
    parts = dataset(spark, sf_dir)
    kept = parts["frames"].where("episode_index % 3 <> 0 and (episode_index % 3 = 1 or value > 5)").select("index")
    e = parts["episodes"].withColumns({"prev_episode_index": F.col("episode_index") - 3, "truncated": F.lit(False), "success": F.col("episode_index") % 2 == 0, "info": F.lit("{}")})
    return algebra.repacked(parts["frames"], e, kept)


@query("""SELECT md5(concat(coalesce(source, 'None'), coalesce(text, 'None'))) AS md5, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def u3_content_identity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy(algebra.identity(F.col("source"), F.col("text")).alias("md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


@query("""SELECT item_id % 5 AS g, string_agg(text, ' ; ' ORDER BY item_id) AS text, count(*) AS n, CAST(sum(length(text)) + 3 * (count(*) - 1) AS BIGINT) AS last_end FROM benchmark GROUP BY 1""")
def u8_merge_texts(spark, sf_dir):
    got = algebra.merged_texts(read(spark, sf_dir, "benchmark").withColumn("g", F.col("item_id") % 5), ["g"], "item_id", "text", " ; ")
    return got.select("g", "text", F.size("spans").cast("long").alias("n"), F.get("spans", F.size("spans") - 1)["end"].cast("long").alias("last_end"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 1000, 6) ELSE round(o_totalprice / 1000, 6) END AS price, 'none' AS note FROM orders""")
def u9_upgrade(spark, sf_dir):
    steps = {0: lambda t: t.withColumn("price", F.round(F.col("o_totalprice") / 1000, 6)), 1: lambda t: t.withColumn("note", F.lit("none"))}
    return algebra.upgraded(read(spark, sf_dir, "orders"), 0, steps, 2).select("o_orderkey", "price", "note")


def _placed(spark, sf_dir):
    return positions(read(spark, sf_dir, "events").select("event_id"), ["event_id"], "pos")


_POS = "WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM events) "


@query(_POS + "SELECT event_id, CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END AS shard FROM p")
def l4_shard_contiguous(spark, sf_dir):
    return sharding.sharded(_placed(spark, sf_dir), 7).select("event_id", "shard")


@query(_POS + "SELECT event_id, pos % 7 AS shard FROM p")
def l5_shard_strided(spark, sf_dir):
    return sharding.sharded(_placed(spark, sf_dir), 7, False).select("event_id", "shard")


@query(_POS + "SELECT event_id, pos // (n // 7) AS shard FROM p WHERE pos < n - n % 7")
def l6_shard_drop_last(spark, sf_dir):
    return sharding.sharded(_placed(spark, sf_dir), 7, True, "drop_last").select("event_id", "shard")


@query(_POS + "SELECT event_id, pos % 7 AS shard FROM p UNION ALL SELECT event_id, (n + pos) % 7 FROM p WHERE pos < (7 - n % 7) % 7")
def l6_shard_pad_last(spark, sf_dir):
    return sharding.sharded(_placed(spark, sf_dir), 7, False, "pad_last").select("event_id", "shard")


@query("SELECT CAST(round_even(count(*) * 2.375, 0) AS BIGINT) AS n_rows, count(*) AS n_distinct, 3 AS most, 2 AS least FROM events")
def l12_resample_exact(spark, sf_dir):
    each = sharding.resampled(_placed(spark, sf_dir), 2.375, 5).groupBy("pos").agg(F.count("*").alias("c"))
    return each.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_distinct"), F.max("c").cast("int").alias("most"), F.min("c").cast("int").alias("least"))


@query("""WITH b AS (SELECT i AS worker, n // 6 + CASE WHEN i < n % 6 THEN 1 ELSE 0 END AS base, CAST(round_even(n * 1.3, 0) AS BIGINT) AS target, n FROM (SELECT count(*) AS n FROM events), range(0, 6) t(i)),
w AS (SELECT worker, target * base // n AS q, row_number() OVER (ORDER BY (target * base) % n DESC, worker) AS r, target - sum(target * base // n) OVER () AS more FROM b)
SELECT worker, CAST(q + CASE WHEN r <= more THEN 1 ELSE 0 END AS BIGINT) AS quota FROM w""")
def l13_worker_quotas(spark, sf_dir):
    n = read(spark, sf_dir, "events").count()
    workers = spark.range(6).select(F.col("id").alias("worker"), F.when(F.col("id") < n % 6, n // 6 + 1).otherwise(n // 6).cast("long").alias("base"), F.lit(sharding.target_rows(n, 1.3)).cast("long").alias("target"))
    return sharding.worker_quotas(workers, "base", "target").select("worker", "quota")


@query("""SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS source, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def g26_mix_summary(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a handful
    parts = [events.where(F.col("event_type") == t).select(F.col("event_id").alias("pos")) for t in types]
    return sharding.mix_summary(sharding.mixed(parts, [1.0 + k % 2 for k in range(len(parts))], 3)).select("source", "n_rows", *rounded("share"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct, CAST(min(event_id) AS BIGINT) AS lo, true AS permuted FROM events")
def l9_shuffle(spark, sf_dir):
    got = sharding.shuffled(_placed(spark, sf_dir), 11)
    some = got.agg(F.count("*").alias("n"), F.countDistinct("shuffled").alias("n_distinct"), F.min("shuffled").alias("lo"), F.avg((F.col("shuffled") != F.col("pos")).cast("int")).alias("m"))
    return some.select("n", "n_distinct", "lo", (F.col("m") > 0.9).alias("permuted"))


@query(_POS + "SELECT t.i AS take, event_id FROM range(0, 100) t(i) JOIN p ON pos = floor(i * n / 100)")
def l15_evenly_spaced(spark, sf_dir):
    return sharding.evenly_spaced(_placed(spark, sf_dir), 100).select("take", "event_id")


@query("""WITH p AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id, i // 64 AS batch, i % 64 AS slot FROM p UNION ALL
SELECT event_type, event_id, (n + i) // 64, (n + i) % 64 FROM p WHERE n + i < ceil(n / 64.0) * 64""")
def l18_flag_batches(spark, sf_dir):
    got = sharding.flag_batches(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 64, "event_id")
    return got.select("event_type", "event_id", F.col("batch").cast("long").alias("batch"), F.col("slot").cast("long").alias("slot"))


@query("""WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC) AS r FROM lineitem) SELECT l_orderkey, l_quantity, r AS rank FROM r WHERE r <= 2""")
def l22_top_k(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), F.col("l_extendedprice").desc())
    ranked = read(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where("rank <= 2").select("l_orderkey", "l_quantity", "rank")


@query("SELECT item_id, instr(text, 'the') - 1 AS start, instr(text, 'the') + 2 AS stop FROM benchmark WHERE instr(text, 'the') > 0")
def c24_token_span(spark, sf_dir):
    got = read(spark, sf_dir, "benchmark").select("item_id", scalars.token_span(F.col("text"), F.lit("the")).alias("s")).where("s is not null")
    return got.select("item_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"))


@query("SELECT doc_id FROM documents WHERE len(list_intersect(regexp_split_to_array(lower(text), '\\s+'), ['left', 'right', 'front', 'token', 'a'])) > 0")
def f11_keywords(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(filters.says_any(F.col("text"), ["left", "right", "front", "token", "a"])).select("doc_id")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE -1 END AS label FROM orders")
def c26_label_map(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.mapped_label(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1}).alias("label"))


@query("""WITH s AS (SELECT l_returnflag AS f, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round((l_quantity - lo) / (hi - lo + 1e-8) * 2 - 1, 6) AS mm, round((l_quantity - m) / (sd + 1e-8), 6) AS ms FROM lineitem JOIN s ON f = l_returnflag""")
def c4_normalize(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    stats = rows.groupBy(F.col("l_returnflag").alias("f")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("sd"))
    met = rows.join(stats, F.col("f") == F.col("l_returnflag"))
    q = F.col("l_quantity")
    both = [codecs.min_max(F.col("lo"), F.col("hi")).encode(q).alias("mm"), codecs.mean_std(F.col("m"), F.col("sd")).encode(q).alias("ms")]
    return met.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", *both).withColumns({n: F.round(n, 6) for n in ("mm", "ms")})


@query("""SELECT joint, low, q01, q99, high FROM (SELECT k - 1 AS joint, round_even(min(x) * 128, 0) / 128 AS low, round_even(quantile_cont(x, 0.01) * 128, 0) / 128 AS q01,
round_even(quantile_cont(x, 0.99) * 128, 0) / 128 AS q99, round_even(max(x) * 128, 0) / 128 AS high FROM (SELECT k, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(k)) GROUP BY 1)""")
def g18_quantile_stats(spark, sf_dir):
    got = metrics.norm_stats(read(spark, sf_dir, "embeddings"), "embedding")
    return got.withColumn("joint", F.col("joint").cast("long"))


@query("""SELECT vec_id, k, round(sqrt(CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END / 64) * sum(x * cos(pi() * (2 * t + 1) * k / 128)), 6) AS c
FROM (SELECT vec_id, t, CAST(embedding[t + 1] AS DOUBLE) AS x FROM embeddings, range(0, 64) r(t)), range(0, 64) s(k) GROUP BY vec_id, k""")
def c10_dct(spark, sf_dir):
    steps = F.col("embedding").cast("array<double>")
    got = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(codecs.dct(steps, 64)).alias("k", "c"))
    return got.select("vec_id", F.col("k").cast("long").alias("k"), *rounded("c"))


@query("SELECT event_id, round((event_id % 640 - 320.5) * (value / 1000) / 600, 9) AS x, round((event_id % 480 - 240.5) * (value / 1000) / 610, 9) AS y, round(value / 1000, 9) AS z FROM events")
def c15_back_project(spark, sf_dir):
    p = geometry.back_projected(F.col("event_id") % 640, F.col("event_id") % 480, F.col("value"), 600.0, 610.0, 320.5, 240.5)
    return read(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", *[F.round(f"p.{c}", 9).alias(c) for c in "xyz"])


@query("""SELECT floor(e1 / 0.25) AS cx, floor(e2 / 0.25) AS cy, count(*) AS n, round(avg(e1), 6) AS x, round(avg(e2), 6) AS y
FROM (SELECT CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2 FROM embeddings) GROUP BY 1, 2""")
def c35_voxels(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(*[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in ((0, "x"), (1, "y"))])
    got = geometry.voxels(e, 0.25, ("x", "y"))
    return got.select(F.col("cell_x").cast("double").alias("cx"), F.col("cell_y").cast("double").alias("cy"), "n", *rounded("x", "y"))


@query("""SELECT count(*) AS n FROM events e, (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'error') WHERE value > lo - 0.5 AND value < hi + 0.5""")
def f17_bounding_box(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return filters.in_bounds_of(events, events.where("event_type = 'error'"), ["value"], 0.5).agg(F.count("*").alias("n"))
