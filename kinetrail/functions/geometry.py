"""Rigid geometry over arrays: 4x4 matrices in row order, quaternions (w, x, y, z), boxes, pinhole cameras, grasps."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.sequences import let


def _sum(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def product(a: Column, b: Column, n: int = 4) -> Column:
    """Matrix product of two n x n matrices as flat arrays."""
    at = lambda m, i, j: F.get(m, F.lit(i * n + j))
    cells = lambda x, y: F.array(*[_sum([at(x, i, k) * at(y, k, j) for k in range(n)]) for i in range(n) for j in range(n)])
    return let(a, lambda x: let(b, lambda y: cells(x, y)))  # bound once: nested products would grow by their cells else


def inverse_rigid(m: Column) -> Column:
    """Inverse of a 4x4 rigid transform."""

    def cells(m: Column) -> Column:
        r = [[F.get(m, F.lit(4 * j + i)) for j in range(3)] for i in range(3)]
        t = [F.get(m, F.lit(4 * i + 3)) for i in range(3)]
        rows = [[*r[i], -_sum([r[i][k] * t[k] for k in range(3)])] for i in range(3)]
        return F.array(*[x for row in rows for x in row], *map(F.lit, (0.0, 0.0, 0.0, 1.0)))

    return let(m, cells)


def _turned(q: list[Column], s: Column) -> list[Column]:
    w, x, y, z = q
    return [
        1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y),
        s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x),
        s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y),
    ]


def _scale(q: list[Column]) -> Column:
    return 2 / _sum([c * c for c in q])


def quaternion_matrix(q: Column) -> Column:
    """3x3 rotation of a quaternion, which need not be of unit length."""

    def cells(q: Column) -> Column:
        parts = [F.get(q, F.lit(i)) for i in range(4)]
        return let(_scale(parts), lambda s: F.array(*_turned(parts, s)))

    return let(q, cells)


def pose_matrix(xyz: Column, q: Column) -> Column:
    """4x4 transform of a position and a quaternion."""

    def cells(r: Column) -> Column:
        rows = [x for i in range(3) for x in (*[F.get(r, F.lit(3 * i + j)) for j in range(3)], F.get(xyz, F.lit(i)))]
        return F.array(*rows, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))

    return let(quaternion_matrix(q), cells)


def pose_of(xyz: list[Column], q: list[Column]) -> Column:
    """As ``pose_matrix``, of columns or fields: nothing is bound, so that the cells are compiled with their common parts computed once."""
    r = _turned(q, _scale(q))
    return F.array(*[x for i in range(3) for x in (*r[3 * i : 3 * i + 3], xyz[i])], *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def euler_matrix(angles: list[Column], order: str = "ZXY") -> Column:
    """3x3 rotation by angles about the axes in turn, each about the moved axes."""
    out = None
    for axis, a in zip(order, angles, strict=True):
        c, s, o, i = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
        m = {"X": (i, o, o, o, c, -s, o, s, c), "Y": (c, o, s, o, i, o, -s, o, c), "Z": (c, -s, o, s, c, o, o, o, i)}[axis]
        m = F.array(*m)
        out = m if out is None else product(out, m, 3)
    return out


def corners(centre: list[Column], size: list[Column], rotation: Column | None = None) -> Column:
    """The eight corners (arrays of three) of a box."""
    out = []
    for k in range(8):
        local = [s * (0.5 if k >> i & 1 else -0.5) for i, s in enumerate(size)]
        if rotation is not None:
            local = [_sum([F.get(rotation, F.lit(3 * i + j)) * local[j] for j in range(3)]) for i in range(3)]
        out.append(F.array(*[c + x for c, x in zip(centre, local, strict=True)]))
    return F.array(*out)


def moved(matrix: Column, point: list[Column]) -> list[Column]:
    """A point under a 4x4 transform."""
    return [_sum([F.get(matrix, F.lit(4 * i + j)) * point[j] for j in range(3)]) + F.get(matrix, F.lit(4 * i + 3)) for i in range(3)]


def back_projected(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float, scale: float = 1000.0) -> Column:
    """Point (x, y, z) of a pixel and its depth."""
    z = depth / scale
    return F.struct(((u - cx) * z / fx).alias("x"), ((v - cy) * z / fy).alias("y"), z.alias("z"))


def angle_to_vertical(matrix: Column) -> Column:
    """Angle in degrees between a pose's z axis and straight down."""

    def angle(m: Column) -> Column:
        z = [F.get(m, F.lit(4 * i + 2)) for i in range(3)]
        norm = F.sqrt(_sum([x * x for x in z]))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -z[2] / norm))))

    return let(matrix, angle)


def centre_distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(_sum([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


def affine(scale: Column, angle: Column, dx: Column, dy: Column) -> Column:
    """2x3 matrix: rotation by degrees, scale, shift."""
    c, s = F.cos(F.radians(angle)) * scale, F.sin(F.radians(angle)) * scale
    return F.array(c, -s, dx, s, c, dy)


def grasp_decoded(scores: Column, angles: Column, depths: Column, width: Column, most: float = 0.1) -> Column:
    """Expected score, best angle and depth, and a width within limits, from a grasp head's arrays."""
    levels = F.array(*[F.lit(k / 5) for k in range(6)])
    best = lambda a: F.array_position(a, F.array_max(a)) - 1
    expected = F.aggregate(F.zip_with(scores, levels, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
    return F.struct(
        expected.alias("score"),
        (best(angles) * (math.pi / 12)).alias("angle"),
        ((best(depths) + 1) * 0.01).alias("depth"),
        F.greatest(F.lit(0.0), F.least(F.lit(most), width)).alias("width"),
    )


def voxels(points: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y", "z"), by: tuple[str, ...] = ()) -> DataFrame:
    """The mean point of each cell of a grid, and how many it has."""
    cells = [F.floor(F.col(a) / size).alias(f"cell_{a}") for a in axes]
    return points.groupBy(*by, *cells).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in axes])


def extrinsic_noise(matrix: Column, angles: list[Column], shift: list[Column]) -> Column:
    """A 4 x 4 extrinsic moved by a small rotation (Euler XYZ) and translation from the left."""
    r = euler_matrix(angles, "XYZ")
    noise = F.array(*[x for i in range(3) for x in (*[F.get(r, F.lit(3 * i + j)) for j in range(3)], shift[i])], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    return product(noise, matrix)


def projection(intrinsic: Column, world_to_camera: Column, base_to_world: Column | None = None) -> Column:
    """4 x 4 projection from the world's frame, or from a robot's base or another frame whose pose is given."""
    whole = product(intrinsic, world_to_camera)
    return whole if base_to_world is None else product(whole, base_to_world)


def gaussian_wasserstein(a: list[Column], size_a: list[Column], b: list[Column], size_b: list[Column]) -> Column:
    """2-Wasserstein distance of axis-aligned boxes as Gaussians with deviations of half their sizes."""
    centre = _sum([(x - y) ** 2 for x, y in zip(a, b, strict=True)])
    return F.sqrt(centre + _sum([((s - t) / 2) ** 2 for s, t in zip(size_a, size_b, strict=True)]))


def box_wasserstein(a: list[Column], size_a: list[Column], turn_a: Column, b: list[Column], size_b: list[Column], turn_b: Column) -> Column:
    """Distance of boxes at any rotation (3 x 3, row order) as Gaussians whose deviations are their sizes, turned; at least the root of 1e-7."""

    def spread(size: list[Column], turn: Column) -> list[Column]:
        at = lambda i, k: F.get(turn, F.lit(3 * i + k))
        return [_sum([at(i, k) * size[k] * at(j, k) for k in range(3)]) for i in range(3) for j in range(3)]

    centre = _sum([(x - y) * (x - y) for x, y in zip(a, b, strict=True)])
    apart = _sum([(x - y) * (x - y) for x, y in zip(spread(size_a, turn_a), spread(size_b, turn_b), strict=True)])
    return F.sqrt(F.greatest(centre + apart, F.lit(1e-7)))


def intrinsic_4x4(k: Column) -> Column:
    """A camera's 3 x 3 intrinsic (9 numbers, row order) in a 4 x 4."""
    at = [F.get(k, F.lit(i)).cast("double") for i in range(9)]
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*at[:3], zero, *at[3:6], zero, *at[6:], zero, zero, zero, zero, one)


@dataclass(frozen=True)
class Joint:
    """A joint of a chain: where it sits on the link before (4x4, row order), its axis, and how it moves: turn, slide or fixed."""

    origin: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    axis: tuple[float, float, float] = (0.0, 0.0, 1.0)
    kind: str = "turn"

    def pose(self, at: Column | None) -> Column:
        """The link's pose on the one before for the joint's value: each cell is linear in its sine and cosine, or in itself."""
        origin, k = np.array(self.origin, float).reshape(4, 4), np.array(self.axis, float)
        k = k / np.linalg.norm(k)
        still, one, two = np.eye(4), np.zeros((4, 4)), np.zeros((4, 4))
        if self.kind == "turn":
            still[:3, :3] = np.outer(k, k)
            one[:3, :3] = np.eye(3) - np.outer(k, k)
            two[:3, :3] = [[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]]
            values = (F.cos(at), F.sin(at))
        elif self.kind == "slide":
            one[:3, 3] = k
            values = (at,)
        elif self.kind == "fixed":
            values = ()
        else:
            raise ValueError(f"a joint turns, slides or is fixed, not {self.kind}")
        parts = [(origin @ m).ravel().tolist() for m in (still, one, two)]
        return F.array(*[_sum([F.lit(parts[0][i]), *[parts[1 + j][i] * v for j, v in enumerate(values) if parts[1 + j][i]]]) for i in range(16)])


def link_poses(joints: list[Joint], values: Column) -> Column:
    """Poses on the base of all links of a chain, from the values of its joints that move, in order; null where a value is missing."""
    steps, moving = [], 0
    for joint in joints:
        steps.append(joint.pose(None if joint.kind == "fixed" else F.get(values, F.lit(moving))))
        moving += joint.kind != "fixed"
    unit = F.array(F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)]))
    poses = F.aggregate(F.array(*steps), unit, lambda done, m: F.concat(done, F.array(product(F.element_at(done, -1), m))))
    known = (F.size(values) >= moving) & F.forall(F.slice(values, 1, moving), lambda v: v.isNotNull()) if moving else F.lit(True)
    return F.when(known, F.slice(poses, 2, len(joints)))


def base_to_camera(camera_on_hand: Column, hand: Column) -> Column:
    """World-to-camera matrix of a camera fixed to a hand, from its pose on the hand and the hand's pose on the base."""
    return product(inverse_rigid(camera_on_hand), inverse_rigid(hand))
