"""Scalar quantisation of feature values and their packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(x: Column, low, high) -> Column:
    """Clips to bounds; bounds may be columns, for bounds by channel."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def uniform(x: Column, low: float, high: float, bits: int) -> Column:
    """Affine map of [low, high] to [0, 2^bits - 1], cut toward zero."""
    return F.floor(affine(x, low, high, bits)).cast("int")


def affine(x: Column, low: float, high: float, bits: int) -> Column:
    """The same map without the cut."""
    return (x - F.lit(float(low))) * F.lit((2**bits - 1) / (high - low))


def uniform_inverse(q: Column, low: float, high: float, bits: int) -> Column:
    return q / F.lit((2**bits - 1) / (high - low)) + F.lit(float(low))


def nonlinear(x: Column, points: Sequence[float]) -> Column:
    """The number of points at or below x, less one, within [0, n - 1]."""
    ordered = F.array(*[F.lit(float(p)) for p in sorted(points)])
    below = F.size(F.filter(ordered, lambda p: p <= x)) - 1
    return F.greatest(F.lit(0), F.least(F.lit(len(points) - 1), below))


def nonlinear_inverse(q: Column, points: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(p)) for p in sorted(points)]), q + 1)


def round_half_even(x: Column) -> Column:
    """The forward value of a straight-through quantiser."""
    return F.rint(x)


def lower_bound(x: Column, bound: float) -> Column:
    return F.greatest(x, F.lit(float(bound)))


def upper_bound(x: Column, bound: float) -> Column:
    return F.least(x, F.lit(float(bound)))


def packed_index(token: Column, channel: Column, tokens: int, channels: int, layout: str = "token") -> Column:
    if layout not in ("token", "channel"):
        raise ValueError(f"unknown layout {layout!r}")
    return token * channels + channel if layout == "token" else channel * tokens + token


def unpacked(index: Column, tokens: int, channels: int, layout: str = "token") -> tuple[Column, Column]:
    """(token, channel) of a place."""
    if layout == "token":
        return F.floor(index / channels).cast("int"), F.pmod(index, F.lit(channels)).cast("int")
    return F.pmod(index, F.lit(tokens)).cast("int"), F.floor(index / tokens).cast("int")
