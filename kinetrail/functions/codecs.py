"""Normalisation codecs over numbers and arrays of joints, and the cosine transform of action chunks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


@dataclass(frozen=True)
class Codec:
    """A pair of column functions; ``a + b`` encodes by a then b and decodes in reverse."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]

    def __add__(self, other: Codec) -> Codec:
        return Codec(lambda x: other.encode(self.encode(x)), lambda x: self.decode(other.decode(x)))


def _range(low: Column, high: Column, eps: float, clamp: bool) -> Codec:
    def encode(x: Column) -> Column:
        y = (x - low) / (high - low + eps) * 2 - 1
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y)) if clamp else y

    return Codec(encode, lambda y: (y + 1) / 2 * (high - low + eps) + low)


def min_max(low: Column, high: Column, eps: float = EPS, clamp: bool = False) -> Codec:
    """[low, high] to [-1, 1]; ``clamp`` cuts encoded values only."""
    return _range(low, high, eps, clamp)


def quantile(q01: Column, q99: Column, eps: float = EPS) -> Codec:
    return _range(q01, q99, eps, False)


def mean_std(mean: Column, std: Column, eps: float = EPS) -> Codec:
    return Codec(lambda x: (x - mean) / (std + eps), lambda y: y * (std + eps) + mean)


def over_joints(values: Column, low: Column, high: Column, codec: Callable[[Column, Column], Codec], decode: bool = False) -> Column:
    """A codec of two statistics, joint by joint over arrays."""
    stats = F.arrays_zip(low.alias("a"), high.alias("b"))

    def one(x: Column, s: Column) -> Column:
        made = codec(s["a"], s["b"])
        return made.decode(x) if decode else made.encode(x)

    return F.zip_with(values, stats, one)


def dct(steps: Column, n: int) -> Column:
    """Orthonormal DCT-II of an array of ``n`` steps."""
    weights = [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * t + 1) * k / (2 * n)) for t in range(n)] for k in range(n)]
    return _product(steps, weights)


def inverse_dct(coefficients: Column, n: int) -> Column:
    weights = [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * t + 1) * k / (2 * n)) for k in range(n)] for t in range(n)]
    return _product(coefficients, weights)


def _product(values: Column, weights: list[list[float]]) -> Column:
    rows = F.array(*[F.array(*map(F.lit, row)) for row in weights])
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, values, lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x))


def dct_tokens(steps: Column, n: int, scale: float, least: int) -> Column:
    """Coefficients times ``scale``, rounded half to even, counted from ``least``."""
    return F.transform(dct(steps, n), lambda c: F.bround(c * scale).cast("int") - least)


def from_dct_tokens(tokens: Column, n: int, scale: float, least: int) -> Column:
    return inverse_dct(F.transform(tokens, lambda t: (t + least) / F.lit(float(scale))), n)


def token_text(tokens: Column, base: int = 0) -> Column:
    """Tokens from 0 as characters; ``base`` is added to each code point (at most 0xD7FF)."""
    return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex((t + base).cast("long")), 4, "0")), "UTF-16BE")), "")


def action_text(steps: Column, grippers: int, arm: str = "<arm>", gripper: str = "<gripper>") -> Column:
    """Steps of integer tokens as text: the arms' tokens step by step, then those of the last ``grippers`` joints, each part behind its mark."""
    part = lambda start, n: token_text(F.flatten(F.transform(steps, lambda s: F.slice(s, start(s), n(s)))))
    arms = part(lambda s: F.lit(1), lambda s: F.size(s) - grippers)
    return F.concat(F.lit(arm), arms, F.lit(gripper), part(lambda s: F.lit(-grippers), lambda s: F.lit(grippers)))


def from_action_text(text: Column, joints: int, grippers: int, arm: str = "<arm>", gripper: str = "<gripper>") -> Column:
    """Steps of tokens from what ``action_text`` wrote; null unless each mark stands once and both parts have the same steps."""
    marks = f"^{_quoted(arm)}(.*){_quoted(gripper)}(.*)$"
    codes = lambda k: F.transform(F.filter(F.split(F.regexp_extract(text, f"(?s){marks}", k), ""), lambda c: c != ""), lambda c: F.ascii(c))
    n, arms, tips = joints - grippers, codes(1), codes(2)
    steps = F.floor(F.size(arms) / n).cast("int")
    made = F.transform(F.sequence(F.lit(0), steps - 1), lambda k: F.concat(F.slice(arms, k * n + 1, n), F.slice(tips, k * grippers + 1, grippers)))
    once = (F.size(F.split(text, _quoted(arm))) == 2) & (F.size(F.split(text, _quoted(gripper))) == 2) & F.startswith(text, F.lit(arm))
    whole = once & (F.size(arms) == steps * n) & (F.size(tips) == steps * grippers)
    return F.when(whole & (steps > 0), made).when(whole, F.array().cast("array<array<int>>"))


def _quoted(mark: str) -> str:
    return f"\\Q{mark}\\E"
