"""Message logs (topic, log_time in ns, data): ranges, chunks, batches, and the last message carried along."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topic_ranges(messages: DataFrame) -> DataFrame:
    """(topic, n, min_log_time, max_log_time)."""
    return messages.groupBy("topic").agg(F.count("*").alias("n"), F.min("log_time").alias("min_log_time"), F.max("log_time").alias("max_log_time"))


def summary(messages: DataFrame, order: str) -> DataFrame:
    """One row: count, topics in order of first appearance, first and last time."""
    by = messages.groupBy("topic").agg(F.count("*").alias("n"), F.min(order).alias("_first"), F.min("log_time").alias("lo"), F.max("log_time").alias("hi"))
    topics = F.transform(F.array_sort(F.collect_list(F.struct("_first", "topic"))), lambda s: s["topic"])
    return by.agg(F.sum("n").alias("n"), F.array_join(topics, ",").alias("topics"), F.min("lo").alias("min_log_time"), F.max("hi").alias("max_log_time"))


def record_chunks(messages: DataFrame, step: int = 1) -> DataFrame:
    """(topics, start, end): topics of equal range, in units of ``step`` ns, as one replayable chunk [start, end)."""
    ranges = topic_ranges(messages).select("topic", F.floor(F.col("min_log_time") / step).alias("lo"), F.floor(F.col("max_log_time") / step).alias("hi"))
    return ranges.groupBy("lo", "hi").agg(F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("topics")).select("topics", (F.col("lo") * step).alias("start"), ((F.col("hi") + 1) * step).alias("end"))


def replayed(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Messages that any chunk (topics, start, end) names, once each."""
    each = chunks.select(F.explode(F.split("topics", ",")).alias("_topic"), "start", "end")
    return messages.join(each, (F.col("topic") == F.col("_topic")) & (F.col("log_time") >= F.col("start")) & (F.col("log_time") < F.col("end")), "left_semi")


def batch_by_count(messages: DataFrame, topic: str, k: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``messages`` with ``batch``: a new one at each message after k of ``topic``; a window sum over each log."""
    seen = F.sum((F.col("topic") == topic).cast("long")).over(Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("batch", F.floor(F.greatest(seen - 1, F.lit(0)) / k).cast("long"))


@dataclass(frozen=True)
class Monitor:
    """A batch holds at least ``least`` messages of the topic, goes on for ``lookahead`` ns, and has at most ``most``."""

    topic: str
    least: int
    most: int
    lookahead: int = 0


class Splitter:
    """State of the batches of one log: counts and time limits of the monitored topics."""

    def __init__(self, monitors: tuple[Monitor, ...], state: dict | None = None):
        self.monitors = {m.topic: m for m in monitors}
        self.counts: dict[str, list] = {m.topic: [0, None] for m in monitors}
        self.batch = 0
        if state:
            self.batch, self.counts = state["batch"], {t: list(v) for t, v in state["counts"].items()}

    def state(self) -> dict:
        return {"batch": self.batch, "counts": self.counts}

    def place(self, topic: str, time: int) -> int:
        """The batch of the next message."""
        monitor = self.monitors.get(topic)
        if monitor is None:
            return self.batch
        count, limit = self.counts[topic]
        if (limit is not None and time > limit) or count + 1 > monitor.most:
            self.batch += 1
            self.counts = {t: [0, None] for t in self.monitors}
            count, limit = 0, None
        count += 1
        if limit is None and count >= monitor.least:
            limit = time + monitor.lookahead
        self.counts[topic] = [count, limit]
        return self.batch


def batched(messages: DataFrame, monitors: tuple[Monitor, ...], log: str, order: list[str], keep_equal_times: bool = True) -> DataFrame:
    """``messages`` with ``batch``, by the state machine over each log in order; batches of a log depend on all before.

    Sorted rows stream through, so a long log needs no memory. With ``keep_equal_times``
    messages of the splitting time all go to the new batch.
    """
    schema = messages.withColumn("batch", F.lit(0).cast("long")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, splitter = None, None
        for frame in frames:
            out = []
            for key, topic, time in zip(frame[log], frame["topic"], frame["log_time"], strict=True):
                if splitter is None or key != at:
                    at, splitter = key, Splitter(monitors)
                out.append(splitter.place(topic, time))
            yield frame.assign(batch=out)

    done = messages.repartition(log).sortWithinPartitions(log, *order).mapInPandas(run, schema)
    if keep_equal_times:
        done = done.withColumn("batch", F.max("batch").over(Window.partitionBy(log, "log_time")))
    return done


def last_of_topics(messages: DataFrame, topics: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """``messages`` with ``last_<topic>``: the newest data of each topic so far."""
    run = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumns({f"last_{t}": F.last(F.when(F.col("topic") == t, F.col("data")), True).over(run) for t in topics})


def carried(batches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(batch, topic, data, log_time): the newest message of every topic from the batches before, also where the topic has none there."""
    if not by:
        raise ValueError("name the columns that tell logs apart")
    last = batches.groupBy(*by, "batch", "topic").agg(F.max_by(F.struct("data", "log_time"), F.struct("log_time", "data")).alias("m"))
    grid = batches.select(*by, "batch").distinct().join(batches.select(*by, "topic").distinct(), by)
    before = Window.partitionBy(*by, "topic").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    met = grid.join(last, [*by, "batch", "topic"], "left").withColumn("_m", F.last("m", True).over(before)).where("_m is not null")
    return met.select(*by, "batch", "topic", "_m.data", "_m.log_time")


def last_messages(batches: DataFrame, by: list[str]) -> DataFrame:
    """(by, batch, topic, data, log_time): the newest message of every topic up to the end of each batch, the batch's own included.

    Batches are cut by time, after equal times have moved to the later one, so a message that was seen before the cut but lies after
    the batch is not among them: there the topic's message before it counts again.
    """
    last = batches.groupBy(*by, "batch", "topic").agg(F.max_by(F.struct("data", "log_time"), F.struct("log_time", "data")).alias("m"))
    grid = batches.select(*by, "batch").distinct().join(batches.select(*by, "topic").distinct(), by)
    run = Window.partitionBy(*by, "topic").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    met = grid.join(last, [*by, "batch", "topic"], "left").withColumn("_m", F.last("m", True).over(run)).where("_m is not null")
    return met.select(*by, "batch", "topic", "_m.data", "_m.log_time")


def aligned(messages: DataFrame, order: list[str], start: Column) -> DataFrame:
    """``messages`` with log times moved so that each topic's first equals ``start``; distances stay."""
    first = messages.groupBy(F.col("topic").alias("_topic")).agg(F.min_by("log_time", F.struct(*order)).alias("_first"))
    met = messages.join(first, F.col("topic") == F.col("_topic"))
    return met.withColumn("log_time", F.col("log_time") - F.col("_first") + start).drop("_topic", "_first")


def time_range(messages: DataFrame, offset: int | None = None, duration: int | None = None) -> DataFrame:
    """Messages from ``offset`` ns after the log's start, for ``duration`` ns (end exclusive)."""
    if offset is None and duration is None:
        return messages
    start = messages.agg(F.min("log_time")).scalar() + (offset or 0)
    out = messages.where(F.col("log_time") >= start)
    return out if duration is None else out.where(F.col("log_time") < start + duration)


def split_at(messages: DataFrame, time: int) -> tuple[DataFrame, DataFrame]:
    return messages.where(F.col("log_time") < time), messages.where(F.col("log_time") >= time)


def of_topics(messages: DataFrame, topics: list[str]) -> DataFrame:
    return messages.where(F.col("topic").isin(topics))


def in_order(messages: DataFrame, by: str = "log_time", descending: bool = False) -> DataFrame:
    """Messages by log or publish time, topics in order among equals; a range shuffle."""
    return messages.orderBy(F.col(by).desc() if descending else F.col(by).asc(), "topic")
