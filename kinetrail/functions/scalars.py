"""Scalar functions: times, names, spans of text, base64 JSON, label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ns: Column) -> Column:
    return ns / F.lit(1e9)


def stamp_to_ns(sec: Column, nanosec: Column) -> Column:
    """A (seconds, nanoseconds) stamp as nanoseconds; fractions of seconds truncate."""
    return (sec * 1e9).cast("long") + nanosec


def downscaled(length: Column, scale: float) -> Column:
    """max(1, round(length * scale)), half to even."""
    return F.greatest(F.lit(1), F.bround(length * scale)).cast("long")


def token_span(text: Column, target: Column) -> Column:
    """(start, end) of the first occurrence, from 0 and end exclusive; null if there is none."""
    start = F.instr(text, target) - 1
    return F.when(start >= 0, F.struct(start.alias("start"), (start + F.length(target)).alias("end")))


def clean_descriptions(texts: Column) -> Column:
    """Trimmed, empty ones dropped, each once in order."""
    return F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""))


def to_base64_json(value: Column) -> Column:
    return F.base64(F.encode(F.to_json(value), "UTF-8"))


def from_base64_json(text: Column, schema: str) -> Column:
    return F.from_json(F.decode(F.unbase64(text), "UTF-8"), schema)


def mapped_label(label: Column, labels: dict[str, int]) -> Column:
    """Index of a label, -1 for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit(-1))


def camera_topic(topic: Column, kind: str) -> Column:
    """``/a/b`` of a camera as the topic of one of its streams."""
    return F.concat(F.rtrim(topic, F.lit("/")), F.lit("/"), F.lit(kind))


def phrase_score(logits: Column, start: Column, end: Column) -> Column:
    """Mean of token logits in [start, end)."""
    part = F.slice(logits, start + 1, end - start)
    return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)


def picked(items: Column, seed: int, *keys: Column) -> Column:
    """An item chosen by a seeded hash of the keys; null for none."""
    return F.get(items, F.pmod(F.xxhash64(F.lit(seed), *keys), F.greatest(F.size(items), F.lit(1))).cast("int"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a seeded hash of the keys: the same on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def gaussian(seed: int, *keys: Column) -> Column:
    """A standard normal number from the keys (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))


def joint_noise(joints: Column, spread: list[float], seed: int, *keys: Column) -> Column:
    """Joints plus uniform noise of +- spread each."""
    noise = F.array(*[(2 * uniform(seed + k, *keys) - 1) * s for k, s in enumerate(spread)])
    return F.zip_with(joints, noise, lambda a, b: a + b)
