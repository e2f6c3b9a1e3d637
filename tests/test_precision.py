"""Average precision against a computation one by one, with ties, ignored boxes, and classes cut by range partitions."""

import random

from pyspark.sql import functions as F

from kinetrail.operators import evaluation, metrics

BOX = "image long, label string, {} long, {}x double, {}s double"


def boxes(rng, n):
    return [(rng.randrange(6), rng.choice("AB"), k, rng.randrange(40) / 4, float(rng.choice([2, 3]))) for k in range(n)]


def by_hand(preds, truths, threshold, ignored, label):
    judged, claimed = [], set()
    for image, of, pred, x, s, score in sorted(preds, key=lambda p: (-p[5], p[0], p[2])):
        if of != label:
            continue
        near = []
        for t_image, t_of, gt, tx, ts in truths:
            if (t_image, t_of) == (image, of):
                shared = max(min(x + s / 2, tx + ts / 2) - max(x - s / 2, tx - ts / 2), 0.0)
                near.append((shared / (s + ts - shared), -gt, gt))
        best = max(near, default=(0.0, 0, None))
        hit = best[0] > threshold
        first = hit and best[2] not in claimed
        if hit:
            claimed.add(best[2])
        if not (hit and best[2] in ignored):
            judged.append(first)
    n = sum(t[1] == label and t[2] not in ignored for t in truths)
    hits = [k for k, ok in enumerate(judged) if ok]
    points = [((c + 1) / n, (c + 1) / (k + 1)) for c, k in enumerate(hits)]
    envelope = [max(p for _, p in points[c:]) for c in range(len(points))]
    return n, sum(envelope) / n, max((r for r, _ in points), default=0.0)


def made(spark):
    rng = random.Random(3)
    truths = boxes(rng, 60)
    preds = [(*b, float(rng.randrange(12))) for b in boxes(rng, 240)]
    p = spark.createDataFrame(preds, BOX.format("pred_id", "p_", "p_s") + ", score double").withColumnRenamed("p_ss", "p_sx")
    t = spark.createDataFrame(truths, BOX.format("gt_id", "t_", "t_s")).withColumnRenamed("t_ss", "t_sx")
    return preds, truths, p, t


def test_precision_by_hand_with_ignored_boxes_and_ties(spark):
    preds, truths, p, t = made(spark)
    ignored = {r[2] for r in truths if r[2] % 5 == 0}
    got = metrics.detection_ap(p, t.withColumn("ignore", F.col("gt_id") % 5 == 0), [0.25, 0.5], metrics.iou_axis_aligned("p", "t", ("x",))).collect()
    assert len(got) == 4
    for r in got:
        n, ap, recall = by_hand(preds, truths, r.threshold, ignored, r.label)
        assert r.n_truths == n and abs(r.ap - ap) < 1e-9 and abs(r.recall - recall) < 1e-9


def test_ranges_share_pairs_and_order(spark):
    preds, truths, p, t = made(spark)
    got = evaluation.area_ap(p, t, {"small": (0.0, 2.5), "large": (2.5, 9.0)}, F.col("t_sx"), [0.25, 0.5], metrics.iou_axis_aligned("p", "t", ("x",))).collect()
    assert len(got) == 8
    for r in got:
        ignored = {b[2] for b in truths if (b[4] < 2.5) != (r.area == "small")}
        n, ap, recall = by_hand(preds, truths, r.threshold, ignored, r.label)
        assert r.n_truths == n and abs(r.ap - ap) < 1e-9 and abs(r.recall - recall) < 1e-9


def test_pairs_are_aggregated_without_sorting_them(spark):
    _, _, p, t = made(spark)
    plan = metrics.aims(p, t, 0.25, metrics.iou_axis_aligned("p", "t", ("x",)))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_an_envelope_over_pieces_is_that_of_the_whole_curve(spark):
    rng = random.Random(5)
    p = [rng.random() for _ in range(200)]
    rows = [("a", k // 30, k, k / 200, (k + 1) / 200, v) for k, v in enumerate(p)]
    curve = spark.createDataFrame(rows, "of string, _part int, _k int, _r0 double, r double, p double")
    got = metrics.average_precision(curve, ["of"]).first()
    assert abs(got.ap - sum(max(p[k:]) for k in range(200)) / 200) < 1e-9 and got.recall == 1.0
