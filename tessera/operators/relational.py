"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, time: str, value: str, tie: str) -> DataFrame:
    """Each left row with the last right value at or before its time.

    One shuffle by key: both sides are stacked, and the last value carried along in order of time.
    """
    a = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias(f"last_{value}"), F.lit(1).alias("side"))
    cells = [F.col(by), F.col(time), F.col(value).alias(f"last_{value}"), F.lit(0).alias("side"), F.col(tie)]
    b = right.select(*cells)
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(time, "side", tie).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(f"last_{value}", F.last(f"last_{value}", ignorenulls=True).over(order))
    return filled.where("side = 1").select(*left.columns, f"last_{value}")


def positional(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows side by side by position; a row without its counterpart is an error."""
    joined = left.withColumn("in_left", F.lit(True)).join(right.withColumn("in_right", F.lit(True)), keys, "full")
    whole = F.when(F.col("in_left").isNull() | F.col("in_right").isNull(), F.raise_error(F.lit("rows differ in number")).cast("boolean")).otherwise(True)
    return joined.where(whole).drop("in_left", "in_right")


def subset(rows: DataFrame, kept: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is listed, and listed keys without a row."""
    return rows.join(kept, key, "left_semi"), kept.join(rows, key, "left_anti")
