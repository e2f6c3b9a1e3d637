"""Column functions over arrays of steps: padding, resampling, deltas, fixed history and prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``value`` once for ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pad_ends(steps: Column) -> Column:
    """Nulls at the head and tail become the nearest value; nulls between stay, all nulls stay. An empty array is an error."""

    def filled(a: Column) -> Column:
        at = F.filter(F.transform(a, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
        ends = F.struct(F.array_min(at).alias("lo"), F.array_max(at).alias("hi"))
        return let(ends, lambda e: F.transform(a, lambda v, i: F.when(i < e["lo"], F.get(a, e["lo"])).when(i > e["hi"], F.get(a, e["hi"])).otherwise(v)))

    return F.when(F.size(steps) == 0, F.raise_error(F.lit("nothing to pad with"))).otherwise(let(steps, filled))


def linear(steps: Column, n: Column | int) -> Column:
    """``n`` values evenly spaced from the first step to the last, linearly between; one step is repeated."""
    n = F.lit(n) if isinstance(n, int) else n

    def at(a: Column, k: Column) -> Column:
        x = F.when(n > 1, k.cast("double") * (F.size(a) - 1) / (n - 1)).otherwise(F.lit(0.0))
        low = F.floor(x).cast("int")
        return F.get(a, low) + (F.coalesce(F.get(a, low + 1), F.get(a, low)) - F.get(a, low)) * (x - low)

    return let(steps, lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda k: at(a, k)))


def every(steps: Column, k: int) -> Column:
    return F.filter(steps, lambda v, i: i % k == 0)


def resample(steps: Column, ratio: float) -> Column:
    """By 1: as it is; by a whole number: every so many; else int(n / ratio) values, linearly. None left is an error."""
    if ratio <= 0:
        raise ValueError("the ratio must be positive")
    if abs(ratio - 1) < 1e-8:
        return steps
    if ratio > 1 and abs(ratio - round(ratio)) < 1e-5 * round(ratio):
        return every(steps, round(ratio))
    n = F.floor(F.size(steps) / F.lit(float(ratio))).cast("int")
    return F.when(n < 1, F.raise_error(F.lit("no steps left"))).otherwise(linear(steps, F.greatest(n, F.lit(1))))


def delta(future: Column, current: Column) -> Column:
    """Future minus current values; a single current value serves all. One side null is an error, both null is null."""
    wide = F.when(F.size(current) == 1, F.array_repeat(F.element_at(current, 1), F.size(future))).otherwise(current)
    both = F.zip_with(future, wide, lambda a, b: a - b)
    return F.when(future.isNull() & current.isNull(), F.lit(None)).when(future.isNull() | current.isNull(), F.raise_error(F.lit("one side of a delta is null"))).otherwise(both)


def velocity(position: Column, times: Column) -> Column:
    """Change over time in seconds between steps; the first step has that of the second."""
    rate = lambda p, t: F.transform(p, lambda v, i: (v - F.get(p, i - 1)) / ((F.get(t, i) - F.get(t, i - 1)) / F.lit(1e9)))
    return let(position, lambda p: let(times, lambda t: F.when(F.size(p) < 2, F.transform(p, lambda v: F.lit(0.0))).otherwise(pad_ends(rate(p, t)))))


def history(steps: Column, at: Column, n: int) -> Column:
    """The ``n`` steps up to place ``at`` (from 0), the first one repeated before the start."""
    return F.transform(F.sequence(at - n + 1, at), lambda i: F.get(steps, F.greatest(i, F.lit(0))))


def prediction(steps: Column, at: Column, n: int) -> Column:
    """The ``n`` steps after place ``at``, the last one repeated behind the end, each with whether it is real."""
    last = F.size(steps) - 1
    return F.transform(F.sequence(at + 1, at + n), lambda i: F.struct(F.get(steps, F.least(i, last)).alias("value"), (i <= last).alias("real")))


def jerk(steps: Column) -> Column:
    """Mean absolute third difference; null under four steps."""
    third = F.transform(F.sequence(F.lit(3), F.size(steps) - 1), lambda i: F.abs(F.get(steps, i) - 3 * F.get(steps, i - 1) + 3 * F.get(steps, i - 2) - F.get(steps, i - 3)))
    return F.when(F.size(steps) > 3, F.aggregate(third, F.lit(0.0), lambda s, x: s + x) / (F.size(steps) - 3))


def mean(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps)
