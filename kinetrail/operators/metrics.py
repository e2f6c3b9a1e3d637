"""Evaluation aggregates: success rates, detection and grasp precision, action errors, quantile statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.tables import positions, stored


def success_rates(results: DataFrame, task: str, success: str) -> DataFrame:
    """(task, n, n_success, rate)."""
    ok = F.sum(F.col(success).cast("long"))
    return results.groupBy(task).agg(F.count("*").alias("n"), ok.alias("n_success"), (ok / F.count("*")).alias("rate"))


def macro_rate(rates: DataFrame) -> DataFrame:
    """One row: the mean of the tasks' rates, each task counting once."""
    return rates.agg(F.avg("rate").alias("macro_rate"), F.count("*").alias("n_tasks"))


def iou_axis_aligned(a: str, b: str, axes: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """Volume overlap of boxes with ``<prefix>_<axis>`` centres and ``<prefix>_s<axis>`` sizes."""
    shared, va, vb = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for x in axes:
        ca, cb, sa, sb = (F.col(f"{p}_{k}{x}") for p, k in ((a, ""), (b, ""), (a, "s"), (b, "s")))
        side = F.least(ca + sa / 2, cb + sb / 2) - F.greatest(ca - sa / 2, cb - sb / 2)
        shared, va, vb = shared * F.greatest(side, F.lit(0.0)), va * sa, vb * sb
    return F.when(va + vb - shared > 0, shared / (va + vb - shared)).otherwise(0.0)


def clamped_sizes(prefix: str, axes: tuple[str, ...] = ("x", "y", "z"), face: float = 2e-4, least: float = 2e-2) -> dict[str, Column]:
    """Sizes of boxes, no smaller than ``least`` where any face is under ``face``."""
    size = [F.col(f"{prefix}_s{x}") for x in axes]
    tiny = F.lit(False)
    for i in range(len(size)):
        for j in range(i):
            tiny = tiny | (size[i] * size[j] < face)
    return {f"{prefix}_s{x}": F.when(tiny, F.greatest(s, F.lit(least))).otherwise(s) for x, s in zip(axes, size, strict=True)}


def aims(predictions: DataFrame, truths: DataFrame, least: float, iou: Column) -> DataFrame:
    """``predictions`` with ``_iou`` and ``_gt`` of the best box of its image and class, null where none overlaps by more than ``least``.

    The best overlap first, then the least id of the boxes that have it: aggregates of one number each, so that pairs stream through
    a join and are never sorted or stored.
    """
    boxes = truths.withColumnsRenamed({"image": "_image", "label": "_label"})
    same = (F.col("image") == F.col("_image")) & (F.col("label") == F.col("_label"))
    columns = predictions.columns
    best = predictions.join(boxes, same & (iou > least), "left").groupBy(*columns).agg(F.max(F.when(F.col("gt_id").isNotNull(), iou)).alias("_iou"))
    return best.join(boxes, same & (iou == F.col("_iou")), "left").groupBy(*columns, "_iou").agg(F.min("gt_id").alias("_gt"))


def _counted(combos: int):
    """Running counts within a range partition sorted by class: (_part, _class, _combo, hits, misses) of each hit, and with ``last`` those of the whole."""
    columns = [f"{n}{k}" for k in range(combos) for n in ("_tp", "_fp")]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not len(batch):
                continue
            of, flags = batch["_class"].to_numpy(), batch[columns].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
                run = flags[a:b].cumsum(0) + sums.get(of[a], 0)
                sums[of[a]] = run[-1]
                for k in range(combos):
                    hit = np.flatnonzero(flags[a:b, 2 * k])
                    if len(hit):
                        yield pd.DataFrame({"_part": part, "_class": of[a], "_combo": k, "hits": run[hit, 2 * k], "misses": run[hit, 2 * k + 1], "last": False})
        if sums:
            yield pd.DataFrame([(part, c, k, run[2 * k], run[2 * k + 1], True) for c, run in sums.items() for k in range(combos)], columns=["_part", "_class", "_combo", "hits", "misses", "last"])

    return counted


def detection_ap(predictions: DataFrame, truths: DataFrame, thresholds: list[float], iou: Column, mode: str = "area") -> DataFrame:
    """(label, threshold, n_truths, ap, recall): average precision of each class with truths.

    predictions: image, label, pred_id, score and box columns; truths: image, label, gt_id and
    theirs, with optional ``ignore``. A prediction aims at its best box of its image and class;
    above a threshold the first by score claims a box, later ones are false, as are those
    below; claims on ignored boxes count as neither. Equal scores go by image and id.
    """
    ignore = F.coalesce("ignore", F.lit(False)) if "ignore" in truths.columns else F.lit(False)
    return ranges_ap(predictions, truths, thresholds, iou, [ignore], mode).drop("range")


def ranges_ap(predictions: DataFrame, truths: DataFrame, thresholds: list[float], iou: Column, ignored: list[Column], mode: str = "area") -> DataFrame:
    """(label, range, threshold, n_truths, ap, recall): as ``detection_ap``, for each of the conditions ``ignored`` over truths (range, from 0).

    All ranges and thresholds share the pairs, the claims and one order of the predictions, a row for each prediction.
    """
    ranges = range(len(ignored))
    out = [f"_out{a}" for a in ranges]
    truths = truths.withColumns(dict(zip(out, ignored, strict=True)))
    flags = truths.select(F.col("image").alias("_image"), F.col("label").alias("_label"), F.col("gt_id").alias("_id"), *out)
    aim = aims(predictions, truths.drop("ignore", *out), min(thresholds), iou).select("image", "label", "pred_id", "score", "_iou", "_gt")
    aim = aim.join(flags, (F.col("image") == F.col("_image")) & (F.col("label") == F.col("_label")) & (F.col("_gt") == F.col("_id")), "left")
    claim = Window.partitionBy("image", "label", "_gt").orderBy(F.col("score").desc(), "pred_id").rowsBetween(Window.unboundedPreceding, 0)
    combos = [(t, a) for t in thresholds for a in ranges]
    hit = {t: F.coalesce(F.col("_iou") > t, F.lit(False)) for t in thresholds}
    first = {t: F.col(f"_first{k}") for k, t in enumerate(thresholds)}
    judged = aim.withColumns({f"_first{k}": hit[t] & (F.sum(hit[t].cast("long")).over(claim) == 1) for k, t in enumerate(thresholds)})
    outcomes = []
    for k, (t, a) in enumerate(combos):
        left = hit[t] & F.coalesce(F.col(out[a]), F.lit(False))
        outcomes += [(first[t] & ~left).alias(f"_tp{k}"), (~first[t] & ~left).alias(f"_fp{k}")]
    counts = [F.count_if(~F.col(o)).alias(f"_boxes{a}") for a, o in enumerate(out)]
    total = stored(positions(truths.groupBy("label").agg(*counts), ["label"], "_class"))
    own = judged.join(total.select(F.col("label").alias("_of"), "_class"), F.col("label") == F.col("_of"))
    order = ["_class", "_down", "image", "pred_id"]
    ranked = own.select("_class", (-F.col("score")).alias("_down"), "image", "pred_id", *outcomes).repartitionByRange(*order).sortWithinPartitions(*order)
    names = [c for c in ranked.columns if c == "_class" or c.startswith(("_tp", "_fp"))]
    pieces = stored(ranked.select(*names).mapInPandas(_counted(len(combos)), "_part int, _class long, _combo int, hits long, misses long, last boolean"))
    # Each piece of a class begins where the earlier ones end; a row for each partition, class and combination.
    keys = ["_class", "_combo"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = pieces.where("last").select("_part", *keys, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}0") for c in ("hits", "misses")])
    n = F.element_at(F.array(*[F.col(f"_boxes{a}") for a in ranges]), (F.col("_combo") % len(ranges) + 1).cast("int"))
    sizes = total.select("label", "_class", F.explode(F.array(*[F.lit(k) for k in range(len(combos))])).alias("_combo"), *[f"_boxes{a}" for a in ranges]).select("label", *keys, n.alias("n_truths")).where("n_truths > 0")
    # Between true positives precision falls, so that these are all the curve's points that count.
    met = pieces.where("not last").join(F.broadcast(begins), ["_part", *keys]).join(sizes.drop("label"), keys)
    c, m = F.col("hits") + F.col("_hits0"), F.col("misses") + F.col("_misses0")
    curve = met.select(*keys, "_part", c.alias("_k"), ((c - 1) / F.col("n_truths")).alias("_r0"), (c / F.col("n_truths")).alias("r"), (c / (c + m)).alias("p"))
    found = average_precision(curve, keys, mode)
    every = begins.select(*keys).distinct().join(sizes, keys)
    t = F.element_at(F.array(*[F.lit(t) for t, _ in combos]), F.col("_combo") + 1)
    zero = [F.coalesce(v, F.lit(0.0)).alias(v) for v in ("ap", "recall")]
    return every.join(found, keys, "left").select("label", (F.col("_combo") % len(ranges)).alias("range"), t.alias("threshold"), "n_truths", *zero)


def average_precision(curve: DataFrame, keys: list[str], mode: str = "area") -> DataFrame:
    """(keys, ap, recall) of curves (keys, _part, _k, _r0, r, p): ``area`` under the falling envelope of precision, or mean at ``11points`` of recall.

    Curves come in pieces that follow each other by ``_part``; _r0 is the recall before a point. A task holds pieces, not curves.
    """
    if mode == "11points":
        points = [F.coalesce(F.max(F.when(F.col("r") >= t / 10, F.col("p"))), F.lit(0.0)) for t in range(11)]
        return curve.groupBy(*keys).agg((sum(points[1:], points[0]) / 11).alias("ap"), F.max("r").alias("recall"))
    piece = [*keys, "_part"]
    later = Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    tops = curve.groupBy(*piece).agg(F.max("p").alias("_top")).select(*piece, F.max("_top").over(later).alias("_later"))
    # From the far end, so that the maximum runs along; a frame open to the end would be computed anew for each row.
    ahead = Window.partitionBy(*piece).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = curve.withColumn("_env", F.max("p").over(ahead)).join(F.broadcast(tops), piece)
    each = F.greatest("_env", "_later") * (F.col("r") - F.col("_r0"))
    return steps.groupBy(*keys).agg(F.sum(each).alias("ap"), F.max("r").alias("recall"))


def grasp_accuracy(grasps: DataFrame, by: list[str], frictions: list[float], top: int = 20) -> DataFrame:
    """(by, friction, k, accuracy): share of the best k by confidence whose score is in (0, friction]; k divides even if there are fewer."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("confidence").desc(), "grasp_id"))
    best = grasps.withColumn("_rank", rank).where(F.col("_rank") <= top)
    each = best.withColumn("friction", F.explode(F.array(*map(F.lit, frictions)))).withColumn("_good", ((F.col("score") > 0) & (F.col("score") <= F.col("friction"))).cast("long"))
    # A row for each k: the best ones up to k, all of them where there are fewer.
    spread = each.withColumn("k", F.explode(F.sequence(F.col("_rank"), F.lit(top))))
    return spread.groupBy(*by, "friction", "k").agg((F.sum("_good") / F.col("k")).alias("accuracy"))


def action_errors(pairs: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """(by, joint errors, xyz, jerk) from (by, step, pred array, truth array): joint 0, xyz 1 to 3, rotation 4 to 7.

    Errors are absolute, averaged over time first, and normed then.
    """
    error = F.zip_with(pred, truth, lambda a, b: F.abs(a - b))
    flat = pairs.select(*by, "step", F.posexplode(error).alias("dim", "e"))
    last = F.max_by("e", "step")
    each = flat.groupBy(*by, "dim").agg(F.avg("e").alias("mean"), last.alias("final"))

    def norm(column: str, low: int, high: int) -> Column:
        return F.sqrt(F.sum(F.when(F.col("dim").between(low, high), F.col(column) * F.col(column)).otherwise(0.0)))

    out = []
    for name, c in (("average", "mean"), ("final", "final")):
        out += [F.max(F.when(F.col("dim") == 0, F.col(c))).alias(f"{name}_joint"), norm(c, 1, 3).alias(f"{name}_xyz"), norm(c, 4, 7).alias(f"{name}_quat")]
    return each.groupBy(*by).agg(*out)


def jerks(steps: DataFrame, by: list[str], pred: str = "pred") -> DataFrame:
    """(by, jerk of joint 0, jerk_xyz): mean size of third differences over time."""
    w = Window.partitionBy(*by).orderBy("step")

    def third(i: int) -> Column:
        x = F.get(F.col(pred), F.lit(i))
        return x - 3 * F.lag(x, 1).over(w) + 3 * F.lag(x, 2).over(w) - F.lag(x, 3).over(w)

    d = steps.select(*by, *[third(i).alias(f"d{i}") for i in range(4)])
    return d.groupBy(*by).agg(F.avg(F.abs("d0")).alias("jerk"), F.avg(F.sqrt(F.col("d1") ** 2 + F.col("d2") ** 2 + F.col("d3") ** 2)).alias("jerk_xyz"))


def best_of(values: DataFrame, by: list[str], mode: str, columns: list[str], modes: int) -> DataFrame:
    """Means over ``by`` of the least value among the first ``modes`` modes."""
    least = values.where(F.col(mode) < modes).groupBy(*by).agg(*[F.min(c).alias(c) for c in columns])
    return least.agg(*[F.avg(c).alias(c) for c in columns])


def norm_stats(rows: DataFrame, column: str, scale: int = 128) -> DataFrame:
    """(joint, low, q01, q99, high) over all rows, linear quantiles rounded half to even to 1 / scale; a joint of nulls gives nulls.

    Exact, by places in range partitions: each joint then looks up eight of them, so that no task holds a joint's values.
    """
    flat = rows.select(F.posexplode(column).alias("joint", "x")).withColumn("x", F.col("x").cast("double"))
    ranked = positions(flat, ["joint", "x"], "_at")
    sizes = ranked.groupBy("joint").agg(F.min(F.when(F.col("x").isNotNull(), F.col("_at"))).alias("_from"), F.count("x").alias("_n"))
    asked = sizes.select("joint", "_from", F.posexplode(F.array(*[F.lit(q) * (F.col("_n") - 1) for q in (0.0, 0.01, 0.99, 1.0)])).alias("_k", "_place"))
    ends = F.array(F.floor("_place"), F.ceil("_place"))
    asked = asked.select("joint", "_k", (F.col("_place") - F.floor("_place")).alias("_part"), "_from", F.posexplode(ends).alias("_end", "_step"))
    met = asked.withColumn("_at", F.col("_from") + F.col("_step")).join(ranked.select("_at", "x"), "_at", "left")
    pair = met.groupBy("joint", "_k", "_part").agg(*[F.max(F.when(F.col("_end") == e, F.col("x"))).alias(n) for e, n in enumerate(("_lo", "_hi"))])
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((1 - F.col("_part")) * F.col("_lo") + F.col("_part") * F.col("_hi"))
    names = enumerate(("low", "q01", "q99", "high"))
    return pair.withColumn("_v", F.bround(value * scale) / scale).groupBy("joint").agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(n) for k, n in names])


def moments(rows: DataFrame, column: str) -> DataFrame:
    """(joint, mean, std, min, max): population deviation."""
    flat = rows.select(F.posexplode(column).alias("joint", "x")).withColumn("x", F.col("x").cast("double"))
    return flat.groupBy("joint").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def navigation_summary(episodes: DataFrame, finite: list[str], plain: list[str]) -> DataFrame:
    """One row of means over all episodes; not finite values of ``finite`` count as 0, unreadable ones (null) stay in the denominator."""
    ok = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull(), 0.0).otherwise(F.col(c))
    means = [(F.sum(ok(c)) / F.count("*")).alias(c) for c in finite] + [(F.sum(F.coalesce(c, F.lit(0.0))) / F.count("*")).alias(c) for c in plain]
    return episodes.agg(F.count("*").alias("n"), *means)


def windowed_losses(losses: DataFrame, every: int, by: str = "name") -> DataFrame:
    """(name, window, mean_loss, last_loss) of logs (name, step, loss) in windows of so many steps."""
    return losses.groupBy(by, F.floor(F.col("step") / every).alias("window")).agg(F.avg("loss").alias("mean_loss"), F.max_by("loss", "step").alias("last_loss"))


def top_scores(scores: DataFrame, by: str, column: str, top: int, threshold: float | None = None) -> DataFrame:
    """(by, query, label, score): best ``top`` of all (query, class) scores of an image, class scores laid end to end; threshold after that."""
    flat = scores.select(by, "query", F.posexplode(column).alias("label", "logit"))
    best = flat.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("logit").desc(), "query", "label"))).where(F.col("_rank") <= top)
    out = best.select(by, "query", "label", (1 / (1 + F.exp(-F.col("logit")))).alias("score"), F.col("_rank").alias("rank"))
    return out if threshold is None else out.where(F.col("score") >= threshold)


def clusters(rows: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    """(cluster, n, centre): k-means of an array column; distances and sums stay on the executors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = rows.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(vectors)
    centres = F.array(*[F.array(*map(F.lit, c.tolist())) for c in model.clusterCenters()])
    return model.transform(vectors).groupBy("cluster").agg(F.count("*").alias("n")).withColumn("centre", F.get(centres, F.col("cluster")))
