"""Depth images as arrays of numbers: depth of projected points, and bin labels of cells for training."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_depths(points: DataFrame, view: list[str], u: str, v: str, depth: str, height: int, width: int) -> DataFrame:
    """(view, depths): an image of height x width numbers in row order, each the least positive depth of the points that fall on the pixel, else 0.

    Pixels are a minimum for each (view, pixel), combined before the shuffle; only a view's pixels meet, never its points.
    """
    x, y = F.floor(u), F.floor(v)
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height) & (F.col(depth) > 0)
    cells = points.where(inside).groupBy(*view, (y * width + x).cast("int").alias("_cell")).agg(F.min(depth).alias("_d"))
    images = cells.groupBy(*view).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_d"))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))
    return images.select(*view, every.alias("depths"))


def bin_labels(depths: Column | str, height: int, width: int, strides: tuple[int, ...] = (8, 16, 32, 64), bins: int = 64, least: float = 0.25, most: float = 10.0, soft: bool = True) -> Column:
    """array<array<double>>: for each cell of each stride, in order, the shares of its pixels in ``bins`` depths from ``least`` to ``most``.

    Depths are clipped to that range. With ``soft`` a pixel counts for the two depths around it, by nearness; else for the
    nearer one (the lower of two equally near). Strides that do not divide the image are refused; null or wrong-sized images give null.
    """
    if bad := [s for s in strides if height % s or width % s]:
        raise ValueError(f"strides {bad} do not divide {height} x {width}")

    def labels(images: pa.Array) -> pa.Array:
        rows = images.to_pylist()
        good = [k for k, r in enumerate(rows) if r is not None and len(r) == height * width and None not in r]
        d = np.clip(np.array([rows[k] for k in good], float).reshape(len(good), height, width), least, most)
        at = (d - least) / (most - least) * (bins - 1)
        low = np.minimum(np.floor(at).astype(int), bins - 2)
        share = at - low if soft else (at - low > 0.5).astype(float)
        image = np.broadcast_to(np.arange(len(good))[:, None, None], d.shape)
        out = []
        for s in strides:
            h, w = height // s, width // s
            cell = (image * h + (np.arange(height) // s)[None, :, None]) * w + (np.arange(width) // s)[None, None, :]
            size = len(good) * h * w * bins
            mass = np.bincount((cell * bins + low).ravel(), (1 - share).ravel(), size) + np.bincount((cell * bins + low + 1).ravel(), share.ravel(), size)
            out.append((mass / (s * s)).reshape(len(good), h * w, bins))
        made = np.concatenate(out, 1) if good else np.zeros((0, 0, bins))
        result: list = [None] * len(rows)
        for i, k in enumerate(good):
            result[k] = made[i].tolist()
        return pa.array(result, pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(labels, "array<array<double>>")(depths)
