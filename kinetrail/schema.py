"""Types of trajectory tables, reserved names and checks of rows."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Frame index columns; times are integer nanoseconds (Spark timestamps end at microseconds).
INDEX = ("index", "episode_index", "frame_index", "task_index", "robot_index", "instruction_index", "timestamp_min", "timestamp_max")
DIMENSIONS = ("task", "robot", "instruction")
RESERVED = frozenset(INDEX) | {"dataset_index"}


def tensor(element: DataType) -> StructType:
    """A tensor: flat values in C order and its shape."""
    return StructType([StructField("data", ArrayType(element)), StructField("shape", ArrayType(IntegerType()))])


JOINTS = StructType(
    [
        StructField("position", tensor(DoubleType())),
        StructField("velocity", tensor(DoubleType())),
        StructField("effort", tensor(DoubleType())),
        StructField("names", ArrayType(StringType())),
        StructField("timestamps", ArrayType(LongType())),
    ]
)
TRANSFORM = StructType(
    [
        StructField("xyz", tensor(DoubleType())),
        StructField("quat", tensor(DoubleType())),
        StructField("timestamps", ArrayType(LongType())),
        StructField("parent_frame_id", StringType()),
        StructField("child_frame_id", StringType()),
    ]
)


def refuse_reserved(*names: str) -> None:
    taken = sorted(RESERVED.intersection(names))
    if taken:
        raise ValueError(f"reserved column names: {', '.join(taken)}")


def valid_times(low: str = "timestamp_min", high: str = "timestamp_max") -> Column:
    """Both set and in order; false, never null."""
    return F.coalesce(F.col(low) <= F.col(high), F.lit(False))


def strict_json(value: Any) -> bool:
    """Whether a value is JSON of finite numbers and text keys all the way down."""
    if value is None or isinstance(value, (bool, int, str)):
        return True
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, list):
        return all(map(strict_json, value))
    return isinstance(value, dict) and all(isinstance(k, str) and strict_json(v) for k, v in value.items())
