"""Feature normalisation of token tables (sample_id, token_idx, vec): four ways to group, one inverse."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V

MODES = ("per_image", "per_token_ln", "split_cls_patch", "split_reg_cls_patch")
EPS = 1e-5


def group_of(mode: str, prefix: int = 0) -> Column:
    """The statistics group of a token: 0 comes first in the side information."""
    if mode == "per_image":
        return F.lit(0)
    if mode == "split_cls_patch":
        return F.when(F.col("token_idx") < prefix, 0).otherwise(1)
    if mode == "split_reg_cls_patch":
        return F.when((F.col("token_idx") >= 1) & (F.col("token_idx") < prefix), 0).otherwise(1)
    raise ValueError(f"unknown mode {mode!r}")


def check(mode: str, prefix: int) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "split_cls_patch" and prefix < 1 or mode == "split_reg_cls_patch" and prefix < 2:
        raise ValueError(f"{mode} needs more prefix tokens than {prefix}")


def statistics(tokens: DataFrame, mode: str, prefix: int = 0) -> DataFrame:
    """(sample_id, part, mu, sigma): sums of each token first, so that only three numbers a token are shuffled."""
    check(mode, prefix)
    row = tokens.select("sample_id", group_of(mode, prefix).alias("part"), V.total(F.col("vec")).alias("s"), V.dot(F.col("vec"), F.col("vec")).alias("q"), F.size("vec").alias("n"))
    sums = row.groupBy("sample_id", "part").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mu = F.col("s") / F.col("n")
    return sums.select("sample_id", "part", mu.alias("mu"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mu * mu, F.lit(0.0)) + EPS).alias("sigma"))


def normalise(tokens: DataFrame, mode: str, prefix: int = 0) -> DataFrame:
    """Adds mu and sigma and replaces vec; by token, nothing is shuffled."""
    check(mode, prefix)
    if mode == "per_token_ln":
        out = tokens.withColumns({"mu": V.mean(F.col("vec")), "sigma": V.spread(F.col("vec"), EPS)})
    else:
        out = tokens.withColumn("part", group_of(mode, prefix)).join(statistics(tokens, mode, prefix), ["sample_id", "part"]).drop("part")
    return out.withColumn("vec", F.transform("vec", lambda x: (x.cast("double") - F.col("mu")) / F.col("sigma")))


def inverse(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("vec", F.transform("vec", lambda x: x * F.col("sigma") + F.col("mu"))).drop("mu", "sigma")


def side_bits(mode: str, images: int = 1, tokens: int = 1) -> int:
    """Two float32 for each group."""
    groups = {"per_image": images, "per_token_ln": images * tokens}.get(mode, 2 * images)
    return groups * 2 * 32


def statistics_bytes(stats: DataFrame) -> DataFrame:
    """Side information by sample: means, then deviations, as little-endian float32."""
    @F.pandas_udf("binary")
    def pack(mu: pd.Series, sigma: pd.Series) -> pd.Series:
        return pd.Series([struct.pack(f"<{2 * len(m)}f", *m, *s) for m, s in zip(mu, sigma)])

    rows = stats.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("part", "mu", "sigma"))).alias("r"))
    return rows.select("sample_id", pack(F.col("r.mu"), F.col("r.sigma")).alias("payload"))
