"""Robot descriptions (the public XML format of links and joints) as tables, poses of all links of branching trees, distances of joints.

A description's joints become rows in the order of the tree. Poses are computed a batch of frames at a time (numpy over all frames of a
robot), the joints of all robots being held by every task: ``MOST`` descriptions at most, more are refused. Frames are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000
#: Kinds of joints of the public format that move, and how.
TURNING, SLIDING = ("revolute", "continuous"), ("prismatic",)
JOINTS = "robot string, place int, joint string, kind string, parent string, child string, origin array<double>, axis array<double>, lower double, upper double, mimic string, multiplier double, offset double, path array<string>"


class BrokenDescription(ValueError):
    pass


def _three(text: str | None, default: tuple[float, ...]) -> list[float]:
    return [float(v) for v in text.split()] if text else list(default)


def _origin(node: ElementTree.Element | None) -> np.ndarray:
    """4 x 4 of an offset and fixed-axis roll, pitch and yaw."""
    out = np.eye(4)
    if node is None:
        return out
    out[:3, 3] = _three(node.get("xyz"), (0, 0, 0))
    (sr, sp, sy), (cr, cp, cy) = (f(_three(node.get("rpy"), (0, 0, 0))) for f in (np.sin, np.cos))
    x, y, z = np.array([[1, 0, 0], [0, cr, -sr], [0, sr, cr]]), np.array([[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]]), np.array([[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]])
    out[:3, :3] = z @ y @ x
    return out


def parsed(robot: str, text: str) -> list[tuple]:
    """Rows of JOINTS, parents before children; links that are no tree with one root are refused."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise BrokenDescription(f"{robot}: {e}") from e
    links = {n.get("name") for n in root.findall("link")}
    below: dict[str, list[ElementTree.Element]] = {}
    held: set[str] = set()
    for joint in root.findall("joint"):
        parent, child = (joint.find(k).get("link") if joint.find(k) is not None else None for k in ("parent", "child"))
        if parent not in links or child not in links or child in held:
            raise BrokenDescription(f"{robot}: joint {joint.get('name')} does not make a tree of known links")
        held.add(child)
        below.setdefault(parent, []).append(joint)
    tops = sorted(links - held)
    if len(tops) != 1:
        raise BrokenDescription(f"{robot}: {len(tops)} links without a parent")
    out: list[tuple] = []
    todo: list[tuple[str, list[str]]] = [(tops[0], [])]
    while todo:
        link, path = todo.pop(0)
        for joint in below.get(link, []):
            name, kind, child = joint.get("name"), joint.get("type"), joint.find("child").get("link")
            if kind not in (*TURNING, *SLIDING, "fixed"):
                raise BrokenDescription(f"{robot}: joint {name} is of the kind {kind}")
            axis = np.array(_three(joint.find("axis").get("xyz") if joint.find("axis") is not None else None, (1, 0, 0)))
            if kind != "fixed" and not np.linalg.norm(axis):
                raise BrokenDescription(f"{robot}: joint {name} has no axis")
            limit, mimic = joint.find("limit"), joint.find("mimic")
            bound = [None if limit is None or kind == "continuous" or limit.get(k) is None else float(limit.get(k)) for k in ("lower", "upper")]
            own = [*path, name] if kind != "fixed" else path
            follows = (None, None, None) if mimic is None else (mimic.get("joint"), float(mimic.get("multiplier", 1)), float(mimic.get("offset", 0)))
            out.append((robot, len(out), name, kind, link, child, _origin(joint.find("origin")).ravel().tolist(), (axis / (np.linalg.norm(axis) or 1)).tolist(), *bound, *follows, own))
            todo.append((child, own))
    if len(out) != len(held):
        raise BrokenDescription(f"{robot}: joints form a ring")
    return out


def joint_table(robots: DataFrame, robot: str = "name", text: str = "content") -> DataFrame:
    """JOINTS rows of descriptions: a row a joint, ``path`` its moving joints from the root, itself included."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in JOINTS.split(", ")]
        for frame in frames:
            yield pd.DataFrame([row for r, t in zip(frame["robot"], frame["text"], strict=True) for row in parsed(r, t)], columns=names)

    return robots.select(F.col(robot).cast("string").alias("robot"), F.col(text).alias("text")).mapInPandas(parse, JOINTS)


def joint_distances(joints: DataFrame) -> DataFrame:
    """(robot, a, b, distance) of moving joints: joints that share a link, or are joined by fixed ones alone, are 1 apart.

    By the last joint that both paths share: a joint above another is as far as their depths differ, others meet where
    their paths part, one step less than both ways up to there.
    """
    moving = joints.where("kind != 'fixed'").select("robot", "joint", "path")
    a, b = (moving.select("robot", F.col("joint").alias(n), F.col("path").alias(f"_{n}")) for n in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    apart = F.size("_a") + F.size("_b") - 2 * shared
    above = (shared == F.size("_a")) | (shared == F.size("_b"))
    return a.join(b, "robot").select("robot", "a", "b", F.when(above, apart).otherwise(apart - 1).alias("distance"))


def _turned(axis: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """n x 4 x 4 turns about an axis."""
    cross = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    out = np.zeros((len(angle), 4, 4))
    out[:, 3, 3] = 1
    out[:, :3, :3] = np.eye(3) + np.sin(angle)[:, None, None] * cross + (1 - np.cos(angle))[:, None, None] * (cross @ cross)
    return out


def _poses(joints: list[dict], value, n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(matrices of each link, rows where a value is missing); ``value`` gives a joint's n values."""
    done, lost = {joints[0]["parent"]: np.broadcast_to(np.eye(4), (n, 4, 4))}, np.zeros(n, bool)
    for j in joints:
        on = done[j["parent"]] @ np.array(j["origin"]).reshape(4, 4)
        if j["kind"] != "fixed":
            at = value(j["joint"]) if j["mimic"] is None else value(j["mimic"]) * j["multiplier"] + j["offset"]
            lost |= np.isnan(at)
            if j["kind"] in SLIDING:
                move = np.tile(np.eye(4), (n, 1, 1))
                move[:, :3, 3] = at[:, None] * np.array(j["axis"])
            else:
                move = _turned(np.array(j["axis"]), at)
            on = on @ move
        done[j["child"]] = on
    return done, lost


def link_poses(joints: DataFrame, robot: Column | str, values: Column | str, links: list[str] | None = None) -> Column:
    """map<link, 4 x 4 as 16 numbers> on the root, from a frame's robot and map of joint values.

    A joint that mimics another takes its value from that one. Null where the robot is unknown or a moving joint has no value.
    """
    held: dict[str, list[dict]] = {}
    for r in joints.orderBy("robot", "place").limit(MOST * 1000).collect():
        held.setdefault(r.robot, []).append(r.asDict())
        if len(held) > MOST:
            raise ValueError(f"more than {MOST} descriptions")
    shared = joints.sparkSession.sparkContext.broadcast(held)

    def poses(names: pa.Array, states: pa.Array) -> pa.Array:
        out: list[list[tuple] | None] = [None] * len(names)
        kept = states.to_pylist()
        by = pd.Series(names.to_pylist())
        for name, at in by.groupby(by).groups.items():
            if name not in shared.value:
                continue
            rows = [k for k in at if kept[k] is not None]
            maps = [dict(kept[k]) for k in rows]
            done, lost = _poses(shared.value[name], lambda joint: np.array([np.nan if (v := m.get(joint)) is None else v for m in maps], float), len(rows))  # noqa: B023
            for i, k in enumerate(rows):
                if not lost[i]:
                    out[k] = [(link, m[i].ravel().tolist()) for link, m in done.items() if links is None or link in links]
        return pa.array(out, pa.map_(pa.string(), pa.list_(pa.float64())))

    return F.arrow_udf(poses, "map<string, array<double>>")(robot, values)
