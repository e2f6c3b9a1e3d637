"""Predicates as columns, and filters of frames by their dimensions as semi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composite(
    frames: DataFrame,
    episodes: DataFrame,
    tasks: DataFrame | None = None,
    robots: DataFrame | None = None,
    instructions: DataFrame | None = None,
    episode: Column | None = None,
    task: Column | None = None,
    robot: Column | None = None,
    instruction: Column | None = None,
    row: Column | None = None,
) -> DataFrame:
    """Frames whose episode, task, robot and instruction satisfy predicates on those tables' columns, then their own.

    Dimension tables are joined to the episodes on the left, so a predicate sees nulls where an
    episode has none. Frames are cut by semi joins before anything is read of their payload.
    """
    if any(p is not None for p in (episode, task, robot)):
        wanted = episodes
        if task is not None:
            wanted = wanted.join(tasks, "task_index", "left").where(task)
        if robot is not None:
            wanted = wanted.join(robots, "robot_index", "left").where(robot)
        if episode is not None:
            wanted = wanted.where(episode)
        frames = frames.join(wanted.select("episode_index"), "episode_index", "left_semi")
    if instruction is not None:
        frames = frames.join(instructions.where(instruction).select("instruction_index"), "instruction_index", "left_semi")
    return frames if row is None else frames.where(row)


def overlaps(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two closed intervals meet."""
    return (low_a <= high_b) & (low_b <= high_a)


def interval_iou(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Shared length over covered length of two intervals; 0 where nothing is covered."""
    shared = F.greatest(F.least(high_a, high_b) - F.greatest(low_a, low_b), F.lit(0))
    covered = (high_a - low_a) + (high_b - low_b) - shared
    return F.when(covered > 0, shared / covered).otherwise(0.0)


def in_spans(frames: DataFrame, spans: DataFrame, by: list[str], frame: str = "frame_index") -> DataFrame:
    """Frames inside any half-open span [start, end) of the same keys; keys without spans keep all frames."""
    s = spans.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    inside = F.exists("_spans", lambda x: (F.col(frame) >= x["start"]) & (F.col(frame) < x["end"]))
    return frames.join(s, same, "left").where(F.col("_spans").isNull() | inside).drop("_spans", *[f"_{c}" for c in by])


def within_limits(joints: Column, limit: float) -> Column:
    return F.forall(joints, lambda x: (x > -limit) & (x < limit))


def clipped(joints: Column, limit: float) -> Column:
    return F.transform(joints, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def in_box(limits: dict[str, tuple[float | None, float | None]], inclusive: bool = True) -> Column:
    """Columns within (low, high) each; None is unbounded."""
    out = F.lit(True)
    for column, (low, high) in limits.items():
        c = F.col(column)
        if low is not None:
            out = out & (c >= low if inclusive else c > low)
        if high is not None:
            out = out & (c <= high if inclusive else c < high)
    return out


def in_bounds_of(points: DataFrame, others: DataFrame, axes: list[str], margin: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Points strictly inside the bounding box of ``others`` widened by a margin, within ``by``."""
    by = by or []
    box = others.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[f(c).alias(f"_{n}_{c}") for c in axes for f, n in ((F.min, "low"), (F.max, "high"))])
    # Without keys the box is one row, however many points there are.
    met = points.join(box, [F.col(c) == F.col(f"_{c}") for c in by]) if by else points.crossJoin(F.broadcast(box))
    inside = F.lit(True)
    for c in axes:
        inside = inside & (F.col(c) > F.col(f"_low_{c}") - margin) & (F.col(c) < F.col(f"_high_{c}") + margin)
    return met.where(inside).select(*points.columns)


def says_any(text: Column, words: list[str]) -> Column:
    """Whether any whitespace-separated word of the text is among ``words``."""
    return F.arrays_overlap(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, words)))


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def valid_tasks(episodes: DataFrame, error: Column, task: Column, tasks: list[str]) -> DataFrame:
    """Episodes without error whose task is one of ``tasks``."""
    return episodes.where(~F.coalesce(error, F.lit(False)) & task.isin(tasks))


def distractor_flags(distractors: Column) -> dict[str, Column]:
    """is_unique: no distractor; is_hard: more than three."""
    n = F.coalesce(F.size(distractors), F.lit(0))
    return {"is_unique": n == 0, "is_hard": n > 3}


def with_files(episodes: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Episodes all of whose listed paths are among ``files`` (path)."""
    each = episodes.select("episode_index", F.explode(path).alias("_path"))
    lost = each.join(files, F.col("_path") == F.col("path"), "left_anti").select(F.col("episode_index").alias("_lost"))
    return episodes.join(lost, F.col("episode_index") == F.col("_lost"), "left_anti")
