"""Datasets that are joins of several lists: one row for each image with all its annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multi_task(images: DataFrame, annotations: dict[str, DataFrame], key: str = "stem", required: tuple[str, ...] = ()) -> DataFrame:
    """Images with the path of each annotation as a column of its task; rows without a required one are left out."""
    out = images
    for task, rows in annotations.items():
        how = "inner" if task in required else "left"
        out = out.join(rows.select(key, F.col("path").alias(task)), key, how)
    return out


def paired(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """Files of two folders by name: both paths, only where both are there."""
    return left.select(key, F.col("path").alias("left_path")).join(right.select(key, F.col("path").alias("right_path")), key)


def coalesced_lookup(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """Adds `value` from the first list, else from the second; rows in neither are left out."""
    a, b = first.select(key, F.col(value).alias("a")), second.select(key, F.col(value).alias("b"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("a", "b")).drop("a", "b").where(F.col(value).isNotNull())


def feature_sets(keys: dict[str, DataFrame]) -> DataFrame:
    """(name, path by key) of folders of features; folders of different size are an error, as is a missing file."""
    out = None
    for k, rows in keys.items():
        mine = rows.select("name", F.col("path").alias(k))
        out = mine if out is None else out.join(mine, "name", "full")
    complete = F.when(F.array_contains(F.array(*[F.col(k).isNull() for k in keys]), True), F.raise_error(F.lit("folders differ"))).otherwise(True)
    return out.where(complete.cast("boolean"))


def adapted_size(h: Column, w: Column, multiple: int, pad: bool) -> Column:
    """The size that a network takes and what undoes it: padded to a multiple, or resized to the nearest one."""
    near = lambda v: F.greatest(F.rint(v / multiple) * multiple, F.lit(multiple)).cast("int")
    up = lambda v: (F.ceil(v / multiple) * multiple).cast("int")
    f = up if pad else near
    top, left = ((F.floor((up(v) - v) / 2) if pad else F.lit(0)).cast("int") for v in (h, w))
    return F.struct(f(h).alias("h"), f(w).alias("w"), top.alias("top"), left.alias("left"))
