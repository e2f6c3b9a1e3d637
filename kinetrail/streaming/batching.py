"""Message batches over streams: the batch state machine as keyed state, and watermarked sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.messages import Monitor, Splitter


def batched_stream(messages: DataFrame, monitors: tuple[Monitor, ...], log: str = "log", order: tuple[str, ...] = ("topic", "data")) -> DataFrame:
    """(log, topic, log_time, data, batch) of a stream of messages that arrive in time order for each log.

    Each log's counts and time limits are kept as state; rows of a micro-batch are ordered by time, equal times by ``order``, so that
    with a column of arrival there (such as a sequence number) batches are those of ``operators.messages.batched`` in that order.
    """
    schema = f"{log} string, topic string, log_time long, data string, batch long"

    def place(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        splitter = Splitter(monitors, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["log_time", *order])  # one log's rows of one micro-batch
        placed = [splitter.place(t, int(n)) for t, n in zip(rows["topic"], rows["log_time"], strict=True)]
        state.update((json.dumps(splitter.state()),))
        yield rows.assign(batch=placed)[[log, "topic", "log_time", "data", "batch"]]

    more = [c for c in order if c not in ("topic", "data")]
    keyed = messages.select(F.col(log).cast("string").alias(log), "topic", "log_time", "data", *more).groupBy(log)
    return keyed.applyInPandasWithState(place, schema, "state string", "append", "NoTimeout")


def sessions(messages: DataFrame, gap: str, lateness: str, time: str = "at") -> DataFrame:
    """(topic, start, end, n): runs of a topic's messages no further apart than ``gap``; later ones than ``lateness`` go."""
    window = F.session_window(time, gap)
    out = messages.withWatermark(time, lateness).groupBy("topic", window.alias("w")).agg(F.count("*").alias("n"))
    return out.select("topic", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_counts(messages: DataFrame, size: str, lateness: str, time: str = "at") -> DataFrame:
    """(topic, start, n, last_value): counts in fixed windows."""
    out = messages.withWatermark(time, lateness).groupBy("topic", F.window(time, size).alias("w")).agg(F.count("*").alias("n"), F.max_by("data", time).alias("last_data"))
    return out.select("topic", F.col("w.start").alias("start"), "n", "last_data")
