"""Crops of token grids and images: grids, fusion, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import shapes


def crop_grid(images: DataFrame, crop: int, stride: int, sizes: bool = False) -> DataFrame:
    """(sample_id, crop_idx, top, left) of the sliding crops of (sample_id, h, w); `sizes` keeps h and w of the image."""
    starts = lambda c: shapes.crop_starts(F.col(c), crop, stride)
    tops = images.select("sample_id", "h", "w", F.posexplode(starts("h")).alias("row", "top"))
    both = tops.select("sample_id", "h", "w", "row", "top", F.posexplode(starts("w")).alias("col", "left"), F.size(starts("w")).alias("cols"))
    return both.select("sample_id", (F.col("row") * F.col("cols") + F.col("col")).alias("crop_idx"), "top", "left", *["h", "w"] * sizes)


def fuse_crops(values: DataFrame) -> DataFrame:
    """Mean of each pixel over the crops that cover it: (sample_id, y, x, cls, value)."""
    return values.groupBy("sample_id", "y", "x", "cls").agg((F.sum("value") / F.greatest(F.count("*"), F.lit(1))).alias("value"))


def decode_task(values: DataFrame) -> DataFrame:
    """(sample_id, y, x, label): the class of the largest value, of equals the lowest."""
    best = F.max(F.struct("value", (-F.col("cls")).alias("c")))
    return values.groupBy("sample_id", "y", "x").agg((-best["c"]).alias("label"))


def padded_shapes(images: DataFrame, multiple: int) -> DataFrame:
    """(sample_id, h, w, padded_h, padded_w, valid_roi)."""
    h, w = shapes.up_to_multiple(F.col("h"), multiple), shapes.up_to_multiple(F.col("w"), multiple)
    out = images.select("sample_id", "h", "w", h.alias("padded_h"), w.alias("padded_w"))
    return out.withColumn("valid_roi", shapes.valid_roi(F.col("h"), F.col("w"), F.col("padded_h"), F.col("padded_w")))
