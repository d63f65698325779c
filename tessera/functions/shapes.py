"""Shape arithmetic of images and crops; no pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def up_to_multiple(x: Column, multiple: int) -> Column:
    return (F.ceil(x / multiple) * multiple).cast("int")


def centred(size: Column, padded: Column) -> Column:
    """Where content starts after padding at both sides, the smaller half first."""
    return F.floor((padded - size) / 2).cast("int")


def valid_roi(h: Column, w: Column, padded_h: Column, padded_w: Column) -> Column:
    return F.struct(centred(h, padded_h).alias("top"), centred(w, padded_w).alias("left"), h.cast("int").alias("height"), w.cast("int").alias("width"))


def fit_scale(h: Column, w: Column, max_h: int, max_w: int) -> Column:
    """Shrinks only: at most 1."""
    return F.least(F.lit(1.0), max_h / h, max_w / w)


def resize_to_fit(size: Column, scale: Column) -> Column:
    return F.greatest(F.rint(size * scale).cast("int"), F.lit(1))


def symmetric_padding(size: Column, multiple: int) -> Column:
    """(before, after) so that the size divides."""
    padded = up_to_multiple(size, multiple)
    before = centred(size, padded)
    return F.struct(before.alias("before"), (padded - size.cast("int") - before).alias("after"))


def crop_starts(length: Column, crop: int, stride: int) -> Column:
    """Starts of sliding crops; the last one is moved back to the border."""
    count = F.floor((F.greatest(length - crop + stride - 1, F.lit(0))) / stride).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.greatest(F.least(k * stride, length.cast("int") - crop), F.lit(0)))


def reduce_zero_label(label: Column) -> Column:
    """Label 0 becomes 255 (ignored), others go down by one; 255 stays."""
    return F.when((label == 0) | (label == 255), 255).otherwise(label - 1)
