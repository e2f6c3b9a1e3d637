"""Table functions: converters of a log's messages in order, and samplers that see a whole row, as Python UDTFs for SQL and DataFrames.

A converter runs over a table argument with PARTITION BY the log and ORDER BY its time; what it still holds after the last message comes from
``terminate``. A sampler runs by lateral join: for each row it names other rows of the dataset, a list for each column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def converter(start: Callable[[], dict], step: Callable[[dict, Any], Sequence[tuple]], flush: Callable[[dict], Sequence[tuple]], schema: str):
    """A table function of start(), step(state, message row), flush(state); each gives rows of ``schema``."""

    class Converter:
        def __init__(self):
            self.state = start()

        def eval(self, row):
            yield from step(self.state, row)

        def terminate(self):
            yield from flush(self.state)

    return F.udtf(Converter, returnType=schema)


def converted(messages: DataFrame, log: list[str], order: list[str], function) -> DataFrame:
    """Rows of a converter run over each log in order."""
    return function(messages.asTable().partitionBy(*log).orderBy(*order))


def sampler(choose: Callable[[Mapping[str, Any]], Mapping[str, Sequence[int | None]]]):
    """A table function (_column, _place, _index) of choose(row): for each column, the indices of the rows it is to show, null for none."""

    class Sampler:
        def eval(self, row):
            for column, indices in choose(row.asDict(True)).items():
                for place, index in enumerate(indices):
                    yield column, place, None if index is None else int(index)

    return F.udtf(Sampler, returnType="_column string, _place int, _index long")


def sampled(frames: DataFrame, context: DataFrame, columns: list[str], function, key: str = "index") -> DataFrame:
    """``context`` (key and what the sampler sees) with each of ``columns`` as the array of the values it chose from ``frames``.

    Chosen rows come by an equi join on ``key``; unknown indices and nulls give null values at their places, a column nothing is chosen for an empty array.
    """
    row = F.struct(*[F.col(c).outer() for c in context.columns])
    chosen = context.lateralJoin(function(row)).select(F.col(key).alias("_for"), "_column", "_place", "_index")
    shown = frames.select(F.col(key).alias("_shown"), *[F.col(c).alias(f"_shown_{c}") for c in columns])
    met = chosen.join(shown, F.col("_index") == F.col("_shown"), "left")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_column") == c, F.struct("_place", F.col(f"_shown_{c}").alias("v"))))), lambda s: s["v"]).alias(c) for c in columns]
    made = met.groupBy("_for").agg(*lists)
    kept = [c for c in context.columns if c not in columns]
    out = context.select(*kept).join(made, F.col(key) == F.col("_for"), "left")
    kinds = {c: frames.schema[c].dataType.simpleString() for c in columns}
    return out.select(*kept, *[F.coalesce(c, F.array().cast(f"array<{kinds[c]}>")).alias(c) for c in columns])
