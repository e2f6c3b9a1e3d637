"""Typed columns of datasets: a feature is a struct layout with an encoder and a decoder, kept in the column's metadata.

Metadata lies in the schema, so that Parquet files keep it, ``load`` gives it back, and projections and renames carry it along.
Tables whose features disagree are refused where they are put together (``agreed``). Encoders and decoders are expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField

from kinetrail.schema import JOINTS, TRANSFORM

KEY = "feature"


class FeatureClash(ValueError):
    """A column is not what its feature says, or tables disagree about it."""


@dataclass(frozen=True)
class Feature:
    """``stored`` is the type on disk; encode makes it of a plain value, decode gives the plain value back."""

    name: str
    stored: str
    encode: Callable[[Column], Column] = lambda c: c
    decode: Callable[[Column], Column] = lambda c: c
    version: int = 1


KNOWN: dict[str, Feature] = {}


def registered(feature: Feature) -> Feature:
    """Makes a feature known by name; another of the same name is refused."""
    if KNOWN.get(feature.name, feature) != feature:
        raise FeatureClash(f"feature {feature.name} is known with another meaning")
    KNOWN[feature.name] = feature
    return feature


def _flat(values: Column) -> Column:
    """Rows of equal length as a tensor: values in C order and its shape."""
    return F.struct(F.flatten(values).alias("data"), F.array(F.size(values), F.coalesce(F.size(F.get(values, F.lit(0))), F.lit(0))).alias("shape"))


def _rows(tensor: Column) -> Column:
    many, wide = F.get(tensor["shape"], F.lit(0)), F.get(tensor["shape"], F.lit(1))
    return F.when(many == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(tensor["data"], i * wide + 1, wide)))


_TENSOR = "struct<data: array<double>, shape: array<int>>"
#: Steps of numbers (array<array<double>>) as a tensor.
STEPS = registered(Feature("steps", _TENSOR, lambda c: F.when(c.isNotNull(), _flat(c.cast("array<array<double>>"))), lambda c: F.when(c.isNotNull(), _rows(c))))
JOINT_STATES = registered(Feature("joints", JOINTS.simpleString()))
TRANSFORMS = registered(Feature("transforms", TRANSFORM.simpleString()))
#: Any value as JSON text.
JSON = registered(Feature("json", "string", lambda c: F.to_json(c)))
#: An encoded image with its size and format.
IMAGE = registered(Feature("image", "struct<data: binary, width: int, height: int, format: string>"))


def _mark(feature: Feature) -> dict:
    return {KEY: json.dumps({"name": feature.name, "version": feature.version, "stored": feature.stored}, sort_keys=True)}


def _same(kind: DataType, stored: str) -> bool:
    return kind.simpleString().replace(" ", "").lower() == stored.replace(" ", "").replace("bigint", "bigint").lower()


def features_of(df: DataFrame) -> dict[str, Feature]:
    """Features of a table's columns, as its schema has them; unknown names and other versions are refused."""
    out = {}
    for f in df.schema:
        if KEY in f.metadata:
            mark = json.loads(f.metadata[KEY])
            known = KNOWN.get(mark["name"])
            if known is None or known.version != mark["version"]:
                raise FeatureClash(f"{f.name}: feature {mark['name']} of version {mark['version']} is not known")
            if not _same(f.dataType, known.stored):
                raise FeatureClash(f"{f.name} is {f.dataType.simpleString()}, but feature {known.name} is {known.stored}")
            out[f.name] = known
    return out


def encoded(df: DataFrame, features: Mapping[str, Feature]) -> DataFrame:
    """``df`` with columns encoded and marked by their features; columns already of the stored type are marked only."""
    made = []
    for f in df.schema:
        if f.name not in features:
            made.append(F.col(f.name))
            continue
        feature = features[f.name]
        value = F.col(f.name) if _same(f.dataType, feature.stored) else feature.encode(F.col(f.name)).cast(feature.stored)
        made.append(value.alias(f.name, metadata={**f.metadata, **_mark(feature)}))
    out = df.select(*made)
    features_of(out)
    return out


def decoded(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``df`` with marked columns (or those of ``names``) as plain values, without marks."""
    features = features_of(df)
    plain = lambda f: {k: v for k, v in f.metadata.items() if k != KEY}
    chosen = lambda f: f.name in features and (names is None or f.name in names)
    return df.select(*[features[f.name].decode(F.col(f.name)).alias(f.name, metadata=plain(f)) if chosen(f) else F.col(f.name) for f in df.schema])


def agreed(tables: list[DataFrame]) -> None:
    """Refuses tables that have a column in common with different features, or with one in some tables only."""
    seen: dict[str, tuple[int, StructField]] = {}
    for k, df in enumerate(tables):
        for f in df.schema:
            at, first = seen.setdefault(f.name, (k, f))
            if f.metadata.get(KEY) != first.metadata.get(KEY):
                raise FeatureClash(f"{f.name} has the feature {first.metadata.get(KEY)} in table {at} and {f.metadata.get(KEY)} in table {k}")
