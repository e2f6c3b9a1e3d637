"""Metrics as mergeable states, channels of an evaluation, splits of detection results, attempts and cadences."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrail.operators import metrics


@dataclass(frozen=True)
class Metric:
    """update: states as aggregates of rows; merge: how states of a name go together; result: from merged states."""

    update: Mapping[str, Column]
    merge: Mapping[str, str]
    result: Callable[[Column], Column]


@dataclass(frozen=True)
class MetricSet:
    """Metrics by name, computed in one pass. States are a table: they can be kept, and merged with later ones."""

    of: Mapping[str, Metric]

    def states(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[c.alias(f"{m}_{s}") for m, metric in self.of.items() for s, c in metric.update.items()])

    def merged(self, states: DataFrame, by: list[str]) -> DataFrame:
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        return states.groupBy(*by).agg(*[how[metric.merge[s]](f"{m}_{s}").alias(f"{m}_{s}") for m, metric in self.of.items() for s in metric.update])

    def results(self, states: DataFrame, by: list[str]) -> DataFrame:
        named = states
        out = []
        for m, metric in self.of.items():
            named = named.withColumn(m, F.struct(*[F.col(f"{m}_{s}").alias(s) for s in metric.update]))
            out.append(metric.result(F.col(m)).alias(m))
        return named.select(*by, *out)

    def compute(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return self.results(self.states(rows, by), by)


def mean_of(column: str) -> Metric:
    return Metric({"total": F.sum(column), "n": F.count(column)}, {"total": "sum", "n": "sum"}, lambda s: s["total"] / s["n"])


def most_of(column: str) -> Metric:
    return Metric({"most": F.max(column)}, {"most": "max"}, lambda s: s["most"])


def channels(rows: DataFrame, terminal: Column, step: MetricSet, last: MetricSet, by: list[str]) -> DataFrame:
    """Metrics of every step, and those of terminal steps only."""
    every = step.compute(rows, by)
    return every.join(last.compute(rows.where(terminal), by), by, "left")


def split_means(ap: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, threshold, map, mar) from per-class results and (label, split); a class may be in several."""
    met = ap.join(splits, "label")
    return met.groupBy("split", "threshold").agg(F.avg("ap").alias("map"), F.avg("recall").alias("mar"))


def part_ap(predictions: DataFrame, truths: DataFrame, part: str, thresholds: list[float], iou: Column, mode: str = "area") -> DataFrame:
    """(part, label, ...): average precision within each part, all parts in one pass."""
    label = F.struct(F.col(part).alias("part"), F.col("label").alias("label")).alias("label")
    keyed = [df.select(label, *[c for c in df.columns if c not in ("label", part)]) for df in (predictions, truths)]
    found = metrics.detection_ap(*keyed, thresholds, iou, mode)
    return found.select(F.col("label.part").alias(part), F.col("label.label").alias("label"), *[c for c in found.columns if c != "label"])


def area_ap(predictions: DataFrame, truths: DataFrame, areas: dict[str, tuple[float, float]], area: Column, thresholds: list[float], iou: Column, mode: str = "area", name: str = "area") -> DataFrame:
    """(area, label, ...): average precision for truths of each range [low, high] of ``area``, an expression over truths, all ranges in one pass.

    Truths outside a range are ignored there: they do not count, and predictions that claim them are neither true nor false. A class without a
    truth in a range has no row.
    """
    names, ignored = list(areas), []
    for low, high in areas.values():
        out = (area < float(low)) | (area > float(high))
        ignored.append(F.coalesce(out | F.col("ignore") if "ignore" in truths.columns else out, F.lit(True)))
    found = metrics.ranges_ap(predictions, truths, thresholds, iou, ignored, mode)
    return found.select(F.element_at(F.array(*map(F.lit, names)), F.col("range") + 1).alias(name), *[c for c in found.columns if c != "range"])


def by_class(results: DataFrame, columns: list[str]) -> DataFrame:
    """(label, image, items): detections of an image regrouped by class, best first."""
    items = F.sort_array(F.collect_list(F.struct("score", *columns)), asc=False)
    return results.groupBy("label", "image").agg(items.alias("items"))


def throughput(steps: DataFrame, by: list[str], window: int, left: Column) -> DataFrame:
    """(by, step, mean_time, eta): mean duration of the last ``window`` steps, and time for the ``left`` ones."""
    run = Window.partitionBy(*by).orderBy("step").rowsBetween(1 - window, 0)
    return steps.withColumn("mean_time", F.avg("duration").over(run)).withColumn("eta", F.col("mean_time") * left)


def cadence(values: DataFrame, by: list[str], every: int, column: str) -> DataFrame:
    """(by, bucket, n, mean): a metric that is reset after each ``every`` steps."""
    return values.groupBy(*by, F.floor(F.col("step") / every).alias("bucket")).agg(F.count(column).alias("n"), F.avg(column).alias("mean"))


def worker_mean(values: DataFrame, worker: str, columns: list[str]) -> DataFrame:
    """One row: means over workers of each worker's own mean."""
    own = values.groupBy(worker).agg(*[F.avg(c).alias(c) for c in columns])
    return own.agg(*[F.avg(c).alias(c) for c in columns])


def last_attempts(attempts: DataFrame, job: list[str], order: str) -> DataFrame:
    """The last attempt at each job."""
    rest = [c for c in attempts.columns if c not in job]
    kept = attempts.groupBy(*job).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return kept.select(*job, "_last.*")


def to_retry(attempts: DataFrame, job: list[str], order: str, done: Column, most: int) -> DataFrame:
    """Jobs not done at their last of fewer than ``most`` attempts, with the number made."""
    made = attempts.groupBy(*job).agg(F.count("*").alias("n_attempts"))
    return last_attempts(attempts, job, order).where(~done).join(made, job).where(F.col("n_attempts") < most)


def next_seed(attempts: DataFrame, task: str, seed: str, start: int) -> DataFrame:
    """(task, next_seed): one after the largest used, ``start`` at least."""
    return attempts.groupBy(task).agg(F.greatest(F.lit(start), F.max(seed) + 1).cast("long").alias("next_seed"))


def episode_ends(steps: DataFrame, episode: list[str], order: str, success: Column, limit: int) -> DataFrame:
    """(episode, n_steps, reason): success at any step, else timeout at ``limit`` steps, else stopped."""
    n = F.count("*")
    reason = F.when(F.max(success), "success").when(n >= limit, "timeout").otherwise("stopped")
    return steps.groupBy(*episode).agg(n.alias("n_steps"), reason.alias("reason"), F.max(order).alias("last_step"))
