"""Entropy models: quantised tables, likelihoods and a byte-exact range coder."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Table precision and the least state of the coder.
PRECISION = 16
LOWEST_STATE = 1 << 31
TINY = 1.1754943508222875e-38  # the smallest normal float32


def cdf_table(pmf: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Cumulative frequencies of rows (g, label, p): (g, label, freq, cdf), cdf being the start of the label.

    Every label has a frequency of at least 1; of 2^precision, one is left to the sentinel. What rounding
    leaves goes to the largest residuals, of equals to the lowest labels.
    """
    group, order = Window.partitionBy("g"), Window.partitionBy("g").orderBy("label")
    spare = F.lit((1 << precision) - 1) - F.count("*").over(group)
    scaled = pmf.withColumn("scaled", F.col("p") / F.sum("p").over(group) * spare).withColumn("spare", spare)
    split = scaled.withColumn("extra", F.floor("scaled")).withColumn("left", F.col("spare") - F.sum("extra").over(group))
    ranked = split.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc(F.round(F.col("scaled") - F.col("extra"), 9)), "label")))
    freq = ranked.withColumn("freq", (F.col("extra") + 1 + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long"))
    return freq.select("g", "label", "freq", F.coalesce(F.sum("freq").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cdf"))


def quantised_cdf(pmf: Sequence[float], precision: int = PRECISION) -> list[int]:
    """The same table on the driver, for one pmf, with its end and the sentinel."""
    p = np.asarray(pmf, np.float64)
    total = 1 << precision
    if not 0 < p.size < total or not np.isfinite(p).all() or (p < 0).any() or p.sum() <= 0:
        raise ValueError("a pmf needs finite non-negative values with mass, fewer than the table has places")
    scaled = p / p.sum() * (total - 1 - p.size)
    freq = np.floor(scaled)
    order = np.lexsort((np.arange(p.size), -np.round(scaled - freq, 9)))
    freq[order[: int(total - 1 - p.size - freq.sum())]] += 1
    return [0, *np.cumsum(freq + 1).astype(int).tolist(), total]


def likelihood(labels: DataFrame, pmf: DataFrame) -> DataFrame:
    """Adds the probability of each label, at least the smallest normal float32; a label without one is an error."""
    joined = labels.join(pmf.select("g", "label", "p"), ["g", "label"], "left")
    return joined.withColumn("p", F.greatest(F.coalesce("p", F.raise_error(F.lit("label outside of the pmf")).cast("double")), F.lit(TINY)))


def encode(symbols: Sequence[int], cdf: Sequence[int], precision: int = PRECISION) -> bytes:
    """Range asymmetric coding with a 64-bit state and 32-bit words, last symbol first, little-endian."""
    state, words = LOWEST_STATE, []
    for s in reversed(symbols):
        start, freq = cdf[s], cdf[s + 1] - cdf[s]
        if state >= (LOWEST_STATE >> precision << 32) * freq:
            words.append(state & 0xFFFFFFFF)
            state >>= 32
        state = (state // freq << precision) + state % freq + start
    words += [state >> 32, state & 0xFFFFFFFF]
    return struct.pack(f"<{len(words)}I", *reversed(words))


def decode(data: bytes, count: int, cdf: Sequence[int], precision: int = PRECISION) -> list[int]:
    from bisect import bisect_right

    words = list(struct.unpack(f"<{len(data) // 4}I", data))
    if len(words) < 2 or len(data) % 4:
        raise ValueError("cut off")
    state, at, out = words[0] | words[1] << 32, 2, []
    for _ in range(count):
        low = state & (1 << precision) - 1
        s = bisect_right(cdf, low) - 1
        out.append(s)
        state = (cdf[s + 1] - cdf[s]) * (state >> precision) + low - cdf[s]
        if state < LOWEST_STATE:
            if at == len(words):
                raise ValueError("cut off")
            state, at = state << 32 | words[at], at + 1
    if state != LOWEST_STATE or at != len(words):
        raise ValueError("bytes left over")
    return out


def encode_streams(labels: DataFrame, pmf: DataFrame, precision: int = PRECISION) -> DataFrame:
    """One stream for each (stream_id, g): rows (stream_id, g, n, label) to (stream_id, g, payload).

    A stream is sequential, so it is one task's work; streams are spread over tasks.
    """
    tables = {r.g: quantised_cdf([p for _, p in sorted(r.rows)], precision) for r in pmf.groupBy("g").agg(F.collect_list(F.struct("label", "p")).alias("rows")).collect()}
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        symbols = pdf.sort_values("n")["label"].astype(int).tolist()
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "g": [g], "payload": [encode(symbols, tables[g], precision)]})

    return labels.select("stream_id", "g", "n", "label").groupBy("stream_id", "g").applyInPandas(run, "stream_id long, g int, payload binary")


def decode_streams(streams: DataFrame, pmf: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Rows (stream_id, g, payload, labels) with `decoded`: as many labels of the payload as `labels` has."""
    tables = {r.g: quantised_cdf([p for _, p in sorted(r.rows)], precision) for r in pmf.groupBy("g").agg(F.collect_list(F.struct("label", "p")).alias("rows")).collect()}

    @F.pandas_udf("array<int>")
    def read(payload: pd.Series, g: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([decode(p, k, tables[c], precision) for p, c, k in zip(payload, g, n)])

    return streams.withColumn("decoded", read("payload", "g", F.size("labels")))


def softmax_prior(logits: DataFrame) -> DataFrame:
    """(g, label, p, log2_p) of learned logits (g, label, logit)."""
    group = Window.partitionBy("g")
    e = F.exp(F.col("logit") - F.max("logit").over(group))
    return logits.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(group)).select("g", "label", "p", F.log2("p").alias("log2_p"))


def uniform_pmf(groups: DataFrame, symbols: int) -> DataFrame:
    """(g, label, p): 1 / symbols each."""
    return groups.select("g", F.explode(F.sequence(F.lit(0), F.lit(symbols - 1))).alias("label")).withColumn("p", F.lit(1.0 / symbols))


def cumulative(pmf: DataFrame) -> DataFrame:
    """Adds `cdf`, the mass up to and with each label, at most 1; a label's start is the cdf before it, 0 at first."""
    order = Window.partitionBy("g").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    return pmf.withColumn("cdf", F.least(F.sum("p").over(order), F.lit(1.0)))


def uniform_bits(labels: int, symbols: int) -> float:
    """Bits of labels under the uniform model."""
    return labels * float(np.log2(symbols))


def gaussian_bits(x, sigma: float):
    """Bits of an integer-rounded value under N(0, sigma^2), by the mass of its unit cell; a column."""

    phi = lambda v: 0.5 * (1 + _erf(v / (sigma * 2**0.5)))
    return -F.log2(F.greatest(phi(x + 0.5) - phi(x - 0.5), F.lit(1e-9)))


def _erf(x):
    """The error function as a column, by the rational form of Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))
