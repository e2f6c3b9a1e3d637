"""Scenes: rotated boxes, pose filters, point clouds, viewpoints and grasp collisions."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinetrail.functions.geometry import moved
from kinetrail.tables import stored

CLOSE = 1e-9


def _planes(centre: np.ndarray, size: np.ndarray, axes: np.ndarray) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """Outward normal, offset and corners in turn of the six faces of a box; ``axes`` are its columns."""
    out = []
    for k in range(3):
        u, v = (axes[:, j] * size[j] / 2 for j in range(3) if j != k)
        for sign in (1.0, -1.0):
            normal = sign * axes[:, k]
            middle = centre + normal * size[k] / 2
            out.append((normal, float(normal @ middle), np.array([middle + u + v, middle - u + v, middle - u - v, middle + u - v])))
    return out


def _clipped(polygon: np.ndarray, normal: np.ndarray, offset: float) -> np.ndarray:
    """The part of a convex polygon below a plane."""
    out, apart = [], polygon @ normal - offset
    for k in range(len(polygon)):
        a, b, da, db = polygon[k - 1], polygon[k], apart[k - 1], apart[k]
        if (da > CLOSE) != (db > CLOSE):
            out.append(a + (b - a) * (da / (da - db)))
        if db <= CLOSE:
            out.append(b)
    return np.array(out).reshape(-1, 3)


def _common_volume(a: list, b: list) -> float:
    """Volume that two boxes share: cones from the origin over the faces of either inside the other, shared faces once."""
    total = 0.0
    for mine, other, again in ((a, b, False), (b, a, True)):
        for normal, offset, polygon in mine:
            for n, d, _ in other:
                if again and n @ normal > 1 - CLOSE and abs(d - offset) <= CLOSE:
                    polygon = polygon[:0]
                if len(polygon):
                    polygon = _clipped(polygon, n, d)
            if len(polygon) > 2:
                fan = np.cross(polygon[1:-1] - polygon[0], polygon[2:] - polygon[0])
                total += offset * np.linalg.norm(fan.sum(axis=0)) / 6
    return max(total, 0.0)


@F.pandas_udf(DoubleType())
def _rotated_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        x, y = np.asarray(x, float), np.asarray(y, float)
        origin = x[:3]  # distances from nearby keep their digits
        boxes = [_planes(box[:3] - origin, box[3:6], box[6:].reshape(3, 3)) for box in (x, y)]
        common = _common_volume(*boxes)
        whole = np.prod(x[3:6]) + np.prod(y[3:6]) - common
        out.append(common / whole if whole > 0 else 0.0)
    return pd.Series(out, dtype="float64")


def iou_rotated(a: Column, b: Column) -> Column:
    """Overlap of boxes at any rotation; a box is an array of centre (3), size (3) and rotation (9, row order)."""
    return _rotated_iou(a, b)


def box(centre: list[Column], size: list[Column], rotation: Column) -> Column:
    return F.concat(F.array(*centre, *size), rotation)


def in_workspace(point: list[Column], low: list[float], high: list[float]) -> Column:
    """Whether a point lies in a box, its faces included."""
    return reduce(and_, [(p >= lo) & (p <= hi) for p, lo, hi in zip(point, low, high, strict=True)])


def in_cloud(poses: DataFrame, points: DataFrame, scene: str, axes: tuple[str, ...], margin: float = 0.0) -> DataFrame:
    """Poses inside the bounding box of their scene's points, widened by ``margin``; scenes without points keep none."""
    edges = points.groupBy(F.col(scene).alias("_scene")).agg(*[f(a).alias(f"_{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    met = poses.join(edges, F.col(scene) == F.col("_scene"))
    for a in axes:
        met = met.where((F.col(a) >= F.col(f"_lo_{a}") - margin) & (F.col(a) <= F.col(f"_hi_{a}") + margin))
    return met.select(*poses.columns)


def horizontal_angle(matrix: Column) -> Column:
    """Angle in degrees between a pose's z axis and the horizontal plane, 0 to 90."""
    z = [F.get(matrix, F.lit(4 * i + 2)) for i in range(3)]
    return F.degrees(F.atan2(F.abs(z[2]), F.sqrt(z[0] * z[0] + z[1] * z[1])))


def cloud_moved(points: DataFrame, matrix: Column, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Points under a 4 x 4 transform."""
    return points.withColumns(dict(zip(axes, moved(matrix, [F.col(a) for a in axes]), strict=True)))


def cloud_augmented(points: DataFrame, by: list[str], seed: int, degrees: float = 30.0, shift: float = 0.1, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Each scene turned about z and shifted by amounts drawn from a hash of seed and ``by``: reruns agree, points of a scene move as one."""

    def drawn(k: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *by), F.lit(1 << 30)) / float(1 << 29) - 1

    angle = F.radians(drawn(0) * degrees)
    x, y, z = (F.col(a) for a in axes)
    turned = (F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y, z)
    return points.withColumns({a: v + drawn(k + 1) * shift for k, (a, v) in enumerate(zip(axes, turned, strict=True))})


def viewpoints(spark, n: int) -> DataFrame:
    """(view, x, y, z): n directions spread over the sphere along a golden spiral."""
    k = F.col("view")
    z = (2 * k + 1) / F.lit(n) - 1
    turn = k * (math.pi * (math.sqrt(5) - 1))
    ring = F.sqrt(1 - z * z)
    return spark.range(n).select(F.col("id").alias("view")).select("view", (ring * F.cos(turn)).alias("x"), (ring * F.sin(turn)).alias("y"), z.alias("z"))


def view_rotation(direction: list[Column], angle: Column) -> Column:
    """3 x 3 rotation, row order: first axis along ``direction``, then turned about it by ``angle``."""
    x, y, z = direction
    size, flat = F.sqrt(x * x + y * y + z * z), F.sqrt(x * x + y * y)
    level = flat > 0  # straight up or down any horizontal axis will do
    a = [x / size, y / size, z / size]
    b = [F.when(level, -y / flat).otherwise(F.lit(0.0)), F.when(level, x / flat).otherwise(F.lit(1.0)), F.lit(0.0)]
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    cos, sin = F.cos(angle), F.sin(angle)
    return F.array(*[v for i in range(3) for v in (a[i], b[i] * cos + c[i] * sin, c[i] * cos - b[i] * sin)])


def collision_counts(grasps: DataFrame, points: DataFrame, by: list[str], regions: dict[str, tuple[list[float], list[float]]], key: str, rotation: Column | None = None) -> DataFrame:
    """(by, key, <region>...): how many of a scene's points lie in each region (low, high) of a grasp's own frame.

    Points and grasps (x, y, z each) meet by cells as wide as the regions reach, never as all pairs of a scene.
    """
    reach = max(math.sqrt(sum(max(abs(lo), abs(hi)) ** 2 for lo, hi in zip(*r, strict=True))) for r in regions.values())
    axes = ("x", "y", "z")
    cell = [F.floor(F.col(a) / reach) for a in axes]
    near = F.array(*[F.struct(*[(c + d).alias(f"_{a}") for a, c, d in zip(axes, cell, step, strict=True)]) for step in np.ndindex(3, 3, 3)])
    around = grasps.select(*by, key, *[F.col(a).alias(f"_g{a}") for a in axes], (rotation if rotation is not None else F.lit(None)).alias("_r"), F.explode(near).alias("_c"))
    around = around.select(*by, key, "_gx", "_gy", "_gz", "_r", *[(F.col(f"_c._{a}") - 1).alias(f"_{a}") for a in axes])
    met = around.join(points.select(*by, *axes, *[c.alias(f"_{a}") for a, c in zip(axes, cell, strict=True)]), [*by, "_x", "_y", "_z"])
    away = [F.col(a) - F.col(f"_g{a}") for a in axes]
    turned = [reduce(add, [F.get("_r", F.lit(3 * i + j)) * away[i] for i in range(3)]) for j in range(3)] if rotation is not None else away
    counts = met.groupBy(*by, key).agg(*[F.count_if(in_workspace(turned, *r)).alias(n) for n, r in regions.items()])
    return grasps.select(*by, key).join(counts, [*by, key], "left").select(*by, key, *[F.coalesce(n, F.lit(0)).alias(n) for n in regions])


def suppressed(grasps: DataFrame, by: list[str], key: str, score: str, distance: float, degrees: float, rotation: str | None = None) -> DataFrame:
    """Grasps that no better kept one of their scene lies within ``distance`` of and is turned by at most ``degrees`` from; equal scores go by key.

    The greedy choice by falling score, but in rounds over all scenes at once: undecided grasps without a
    better undecided neighbour are kept and their neighbours go. Neighbours meet by cells once; a
    round is two joins on their links, and a chain of n ever worse neighbours takes n / 2 rounds.
    """
    axes = ("x", "y", "z")
    turned = [] if rotation is None else [F.col(rotation).alias("_r")]
    one = grasps.select(*by, F.col(key).alias("_id"), F.col(score).alias("_s"), *axes, *turned)
    cell = [F.floor(F.col(a) / distance) for a in axes]
    near = F.array(*[F.struct(*[(c + d - 1).alias(f"_{a}") for a, c, d in zip(axes, cell, step, strict=True)]) for step in np.ndindex(3, 3, 3)])
    around = one.select(*by, *[F.col(c).alias(f"{c}2") for c in one.columns if c not in by], F.explode(near).alias("_c")).select("*", "_c.*").drop("_c")
    met = one.withColumns({f"_{a}": c for a, c in zip(axes, cell, strict=True)}).join(around, [*by, *[f"_{a}" for a in axes]])
    close = reduce(add, [(F.col(a) - F.col(f"{a}2")) ** 2 for a in axes]) <= distance**2
    if rotation is not None:  # the angle between two rotations by the trace of one times the other's inverse
        trace = F.aggregate(F.zip_with("_r", "_r2", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        close = close & ((trace - 1) / 2 >= math.cos(math.radians(degrees)))
    better = (F.col("_s") > F.col("_s2")) | ((F.col("_s") == F.col("_s2")) & (F.col("_id") < F.col("_id2")))
    links = stored(met.where(close & better).select(*by, F.col("_id").alias("_good"), F.col("_id2").alias("_bad")))
    gone = None
    while not links.isEmpty():
        waiting = links.select(*by, F.col("_bad").alias("_good")).distinct()
        kept = links.select(*by, "_good").distinct().join(waiting, [*by, "_good"], "left_anti")
        lost = stored(links.join(kept, [*by, "_good"], "left_semi").select(*by, F.col("_bad").alias("_lost")).distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        for side in ("_good", "_bad"):
            links = links.join(lost.withColumnRenamed("_lost", side), [*by, side], "left_anti")
        links = stored(links)
    if gone is None:
        return grasps
    return grasps.join(gone.withColumnsRenamed({"_lost": key}), [*by, key], "left_anti").select(*grasps.columns)
