"""Functions of numeric arrays; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / n)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def spread(a: Column, eps: float = 1e-5) -> Column:
    """sqrt(population variance + eps)."""
    m = mean(a)
    return F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a) + eps)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def slices(a: Column, groups: int, width: int) -> Column:
    """An array as `groups` arrays of `width` neighbours."""
    return F.array(*[F.slice(a, g * width + 1, width) for g in range(groups)])
