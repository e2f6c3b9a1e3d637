"""Stateful converters over streams: rows wait until the watermark has passed them, run in order, and a quiet log is flushed by a timer.

The stream's form of ``operators.imports.converted``: start(log), step(state, message) and flush(state) are the same functions, so a log
that arrives in any order, in any micro-batches, gives the rows that the table form gives, as long as no row is later than the
watermark. Of each log are kept: the converter's state (JSON in value state), rows that the watermark has not passed (list
state), and timers for the earliest of them and for the end of the quiet time; when that fires, flush(state) gives the log's last rows
and the state goes, so that a later message begins the log anew. State is as large as the rows within the watermark's delay and one JSON text a log.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

MS = 1_000_000


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The state store that value, list and timer state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Conversion(StatefulProcessor):
    def __init__(self, rows: StructType, names: list[str], order: list[str], start: Callable, step: Callable, flush: Callable, quiet: int):
        self.rows, self.names, self.quiet = rows, names, quiet
        self.start, self.step, self.flush = start, step, flush
        self.order = [rows.names.index(c) for c in ["log_time", *order]]
        self.time = rows.names.index("log_time")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "state string, last long, earliest long")
        self.held = handle.getListState("held", self.rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(None if v is None or v != v else v for v in r) for frame in rows for r in frame[self.rows.names].itertuples(index=False, name=None)]
        if not fresh:
            return
        text, last, earliest = self.known.get() if self.known.exists() else (None, None, None)
        first = min(r[self.time] for r in fresh)
        self.held.appendList(fresh)
        self.known.update((text, last, first if earliest is None else min(earliest, first)))
        yield from self._run(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists():
            yield from self._run(key, timerValues.getCurrentWatermarkInMs())

    def _run(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Runs what the watermark has passed, flushes at gaps and after the last message of a quiet log, sets the next timers."""
        text, last, earliest = self.known.get()
        state = json.loads(text) if text else None
        out: list[tuple] = []
        if earliest is not None and earliest // MS < watermark:
            message = namedtuple("message", self.rows.names)
            rows = sorted(self.held.get(), key=lambda r: tuple((r[i] is None, r[i]) for i in self.order))
            ready = [r for r in rows if r[self.time] // MS < watermark]
            for r in ready:
                if state is not None and r[self.time] - last > self.quiet:
                    out += self.flush(state)
                    state = None
                state = self.start(key[0]) if state is None else state
                out += self.step(state, message(*r))
                last = r[self.time]
            left = [tuple(r) for r in rows[len(ready) :]]
            if left:
                self.held.put(left)
            else:
                self.held.clear()
            earliest = left[0][self.time] if left else None
        if state is not None and (last + self.quiet) // MS < watermark and (earliest is None or earliest - last > self.quiet):
            out += self.flush(state)
            state = None
        if state is None and earliest is None:
            self.known.clear()
        else:
            self.known.update((None if state is None else json.dumps(state), last, earliest))
            if earliest is not None:
                self.handle.registerTimer(earliest // MS + 1)
            if state is not None:
                self.handle.registerTimer((last + self.quiet) // MS + 1)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def converted_stream(messages: DataFrame, log: str, order: list[str], start: Callable[[object], dict], step: Callable[[dict, object], list[tuple]], flush: Callable[[dict], list[tuple]], schema: str, lateness: str, quiet: int) -> DataFrame:
    """Rows of a stateful converter over a stream of messages (``log``, log_time in ns, others).

    ``order`` tells equal times of a log apart. Rows later than ``lateness`` behind the newest of all logs go, as the watermark
    has it. A log whose next message comes more than ``quiet`` ns after its last one is flushed and begins anew, wherever micro-batches
    end; its last rows come when the watermark is that far. The state must be JSON.
    """
    names = list(messages.sparkSession.createDataFrame([], schema).columns)
    timed = messages.withColumn("_at", F.timestamp_millis(F.floor(F.col("log_time") / MS))).withWatermark("_at", lateness)
    processor = Conversion(messages.schema, names, order, start, step, flush, quiet)
    return timed.groupBy(log).transformWithStateInPandas(processor, schema, "Append", "EventTime")
