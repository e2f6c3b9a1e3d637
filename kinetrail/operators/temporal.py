"""Temporal reads of frames: offset and time windows, chunks, whole episodes, nearest-time sync.

Windows are partitioned by episode, which bounds a task by one recording; where episodes are
uneven the equi-join forms (``offset_join``) split any key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPISODE, INDEX, TIME = "episode_index", "index", "timestamp_min"


def nanoseconds(seconds: float) -> int:
    """Whole nanoseconds, truncated toward zero part by part in double arithmetic."""
    whole = int(seconds)
    return whole * 10**9 + int((seconds - whole) * 1e9)


def _by_index():
    return Window.partitionBy(EPISODE).orderBy(INDEX)


def _at(column: str, offset: int | None, window) -> Column:
    if offset is None:
        return F.when(F.lit(False), F.col(column))
    return F.col(column) if offset == 0 else F.lead(column, offset).over(window) if offset > 0 else F.lag(column, -offset).over(window)


def offset_window(frames: DataFrame, offsets: dict[str, list[int | None]]) -> DataFrame:
    """``frames`` with each column as the array of its values at the offsets; null beyond the episode and for null offsets."""
    window = _by_index()
    return frames.withColumns({c: F.array(*[_at(c, o, window) for o in of]) for c, of in offsets.items()})


def offset_join(frames: DataFrame, column: str, offsets: Column, force_in_episode: bool = False) -> DataFrame:
    """(index, column): values at per-row ``offsets`` (array of int, nulls allowed), by an equi join on position."""
    asked = frames.select(F.col(INDEX).alias("_at"), F.col(EPISODE).alias("_episode"), F.posexplode_outer(offsets).alias("_k", "_offset"))
    there = frames.select((F.col(INDEX)).alias("_found"), F.col(EPISODE).alias("_of"), F.col(column).alias("_value"))
    match = F.col("_at") + F.col("_offset") == F.col("_found")
    if force_in_episode:
        match = match & (F.col("_episode") == F.col("_of"))
    met = asked.join(there, match, "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_value"))))
    return met.groupBy(F.col("_at").alias(INDEX)).agg(F.transform(listed, lambda s: s["_value"]).alias(column))


def delta_window(frames: DataFrame, deltas: dict[str, list[float]], tolerance: float = 0.01) -> DataFrame:
    """Columns as arrays of the values ``deltas`` seconds away, within the tolerance, in the same episode.

    For frames at one time each. A positive delta takes the first match, a negative one the
    last, zero the frame itself; equal times go by index.
    """
    slack = nanoseconds(tolerance)
    order = F.struct(TIME, INDEX)

    def one(column: str, delta: float) -> Column:
        if delta == 0:
            return F.col(column)
        at = nanoseconds(delta)
        near = Window.partitionBy(EPISODE).orderBy(TIME).rangeBetween(at - slack, at + slack)
        return (F.min_by if delta > 0 else F.max_by)(F.col(column), order).over(near)

    return frames.withColumns({c: F.array(*[one(c, d) for d in ds]) for c, ds in deltas.items()})


def delta_join(frames: DataFrame, column: str, delta: float, tolerance: float, width: int) -> DataFrame:
    """``frames`` with ``column`` replaced by its value ``delta`` seconds away, for frames that last from timestamp_min to timestamp_max.

    Overlap is inclusive. Intervals are cut into buckets of ``width`` ns so that the join has an
    equality on (episode, bucket); a pair that shares several buckets counts in the first.
    """
    at, slack = nanoseconds(delta), nanoseconds(tolerance)
    low, high = F.col("timestamp_min") + at - slack, F.col("timestamp_max") + at + slack

    def buckets(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(a / width), F.floor(b / width))

    asked = frames.select(INDEX, EPISODE, low.alias("_low"), high.alias("_high")).withColumn("_bucket", F.explode(buckets(F.col("_low"), F.col("_high"))))
    there = frames.select(
        F.col(EPISODE).alias("_episode"), F.col(INDEX).alias("_index"), F.col("timestamp_min").alias("_min"), F.col("timestamp_max").alias("_max"), F.col(column).alias("_value")
    ).withColumn("_in", F.explode(buckets(F.col("_min"), F.col("_max"))))
    first = F.floor(F.greatest("_low", "_min") / width)
    met = asked.join(there, (F.col(EPISODE) == F.col("_episode")) & (F.col("_bucket") == F.col("_in")) & (F.col("_min") <= F.col("_high")) & (F.col("_max") >= F.col("_low")) & (F.col("_bucket") == first))
    pick = F.min_by if delta > 0 else F.max_by
    found = met.groupBy(F.col(INDEX).alias("_for")).agg(pick(F.struct("_value"), F.struct("_min", "_index")).alias("_found"))
    return frames.join(found, F.col(INDEX) == F.col("_for"), "left").withColumn(column, F.col("_found._value")).drop("_for", "_found")


def chunk(frames: DataFrame, columns: list[str], hist_steps: int = 1, pred_steps: int = 64, pred_interval: int = 1) -> DataFrame:
    """Columns as arrays of ``hist_steps`` values up to the current one and ``pred_steps`` ahead at a stride.

    Steps beyond the episode repeat its edge; steps beyond the last planned one are never read,
    so the right edge is that of the episode.
    """
    window = _by_index()
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def at(column: str, offset: int) -> Column:
        boxed = F.struct(F.col(column).alias("v"))  # a null value is a value, a null box is no row
        if offset == 0:
            return F.col(column)
        edge = F.first(boxed).over(whole) if offset < 0 else F.last(boxed).over(whole)
        moved = F.lag(boxed, -offset).over(window) if offset < 0 else F.lead(boxed, offset).over(window)
        return F.coalesce(moved, edge)["v"]

    offsets = [*range(1 - hist_steps, 1), *(k * pred_interval for k in range(1, pred_steps + 1))]
    return frames.withColumns({c: F.array(*[at(c, o) for o in offsets]) for c in columns})


def sampled_states(frames: DataFrame, columns: list[str], hist: int, pred: int) -> DataFrame:
    """``frames`` with ``<column>_hist``, the ``hist`` values up to each frame, and ``<column>_pred``, the ``pred`` ones after it as (value, real).

    The first value is repeated before an episode's start, the last one behind its end, where real is false. A window of ``hist + pred`` frames
    is read for each, not the episode (``sequences.history`` and ``prediction`` do the same for arrays).
    """
    window = _by_index()
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {}
    for c in columns:
        boxed = F.struct(F.col(c).alias("value"))  # a null value is a value, a null box is no row
        first, last = F.first(boxed).over(whole), F.last(boxed).over(whole)
        made[f"{c}_hist"] = F.array(*[F.coalesce(F.lag(boxed, k).over(window), first)["value"] if k else F.col(c) for k in range(hist - 1, -1, -1)])
        ahead = [F.lead(boxed, k).over(window) for k in range(1, pred + 1)]
        made[f"{c}_pred"] = F.array(*[F.struct(F.coalesce(a, last)["value"].alias("value"), a.isNotNull().alias("real")) for a in ahead])
    return frames.withColumns(made)


def gather(frames: DataFrame, columns: list[str], order: str = INDEX, key: str = EPISODE) -> DataFrame:
    """Every row with all its episode's values of ``columns``: one array an episode, joined back."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    whole = frames.groupBy(F.col(key).alias("_key")).agg(rows.alias("_rows"))
    whole = whole.select("_key", *[F.col(f"_rows.{c}").alias(c) for c in columns])
    return frames.drop(*columns).join(whole, F.col(key) == F.col("_key")).drop("_key")


def nearest(base: DataFrame, stream: DataFrame, value: str, by: list[str], time: str = "log_time") -> DataFrame:
    """``base`` with the ``value`` of the stream's row nearest in time within ``by``, the earlier one of equals, and ``apart``, how far.

    One sort of both sides by time: the last row before and the first after each base row.
    """
    both = base.select(*by, time, F.lit(True).alias("_base"), F.struct(*base.columns).alias("_row"), F.lit(None).cast("long").alias("_t"), F.lit(None).cast(stream.schema[value].dataType).alias("_v"))
    both = both.unionByName(stream.select(*by, time, F.lit(False).alias("_base"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(time).alias("_t"), F.col(value).alias("_v")))
    seen = F.when(~F.col("_base"), F.struct("_t", "_v"))
    # Messages go before base rows of the same time; of equal messages the first is meant on both sides.
    first = both.withColumn("_seen", F.when(~F.col("_base"), F.min_by(F.struct("_t", "_v"), F.struct("_v")).over(Window.partitionBy(*by, time, "_base"))).otherwise(seen))
    order = Window.partitionBy(*by).orderBy(time, "_base")
    back = F.last("_seen", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # The first after a row is the last before it in falling order: a frame open to the end would be computed anew for each row.
    falling = Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col("_base").desc())
    ahead = F.last("_seen", True).over(falling.rowsBetween(Window.unboundedPreceding, -1))
    met = first.withColumn("_back", back).withColumn("_ahead", ahead).where("_base")
    near = F.when(F.col("_back").isNull() | (F.col("_ahead._t") - F.col(time) < F.col(time) - F.col("_back._t")), F.col("_ahead")).otherwise(F.col("_back"))
    return met.withColumn("_near", near).select("_row.*", F.col("_near._v").alias(value), F.abs(F.col("_near._t") - F.col(time)).alias("apart"))


def changes(frames: DataFrame, column: str) -> DataFrame:
    """``frames`` with ``change``: differences to the episode's row before, null for its first. ``column`` is a number or an array."""
    before = F.lag(column).over(_by_index())
    array = frames.schema[column].dataType.typeName() == "array"
    return frames.withColumn("change", F.zip_with(F.col(column), before, lambda a, b: a - b) if array else F.col(column) - before)


def moving_frames(frames: DataFrame, column: str, threshold: float, head: float | None = None, tail: float | None = None) -> DataFrame:
    """Frames where any part of ``column`` moves by more than the threshold, and each episode's first.

    With ``head`` or ``tail`` seconds, static frames go only within that time of the episode's ends.
    """
    marked = changes(frames, column)
    array = frames.schema[column].dataType.typeName() == "array"
    moves = F.exists("change", lambda d: F.abs(d) > threshold) if array else F.abs("change") > threshold
    keep = F.col("change").isNull() | moves
    if head is not None or tail is not None:
        all_of = Window.partitionBy(EPISODE)
        inside = F.lit(False)
        if head is not None:
            inside = inside | (F.col(TIME) - F.min(TIME).over(all_of) <= nanoseconds(head))
        if tail is not None:
            inside = inside | (F.max(TIME).over(all_of) - F.col(TIME) <= nanoseconds(tail))
        keep = keep | ~inside
    return marked.withColumn("_keep", keep).where("_keep").drop("change", "_keep")


def static_mask(frames: DataFrame, column: str, threshold: float, name: str = "static") -> DataFrame:
    """Whether all parts move by less than the threshold; the first frame counts as static."""
    marked = changes(frames, column)
    array = frames.schema[column].dataType.typeName() == "array"
    still = F.forall("change", lambda d: F.abs(d) < threshold) if array else F.abs("change") < threshold
    return marked.withColumn(name, F.coalesce(still, F.lit(True))).drop("change")
