"""Codecs behind the model boundary that quantise: by points, and by products of codebooks with range-coded labels."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import quantise as q
from tessera.operators import entropy, normalise, vq
from tessera.plans.plan import register


@register("nonlinear")
class Nonlinear:
    """Values as the number of their quantisation point, a byte each."""

    def __init__(self, points: Sequence[float], column: str = "vec"):
        if not 0 < len(points) <= 256:
            raise ValueError("1 to 256 points fit a byte")
        self.points, self.column = tuple(points), column

    def encode(self, samples: DataFrame) -> DataFrame:
        digits = F.transform(self.column, lambda x: F.lpad(F.hex(q.nonlinear(x, self.points).cast("long")), 2, "0"))
        return samples.select("sample_id", F.lit("h").alias("stream"), F.unhex(F.array_join(digits, "")).alias("payload"))

    def decode(self, streams: DataFrame) -> DataFrame:
        text = F.hex("payload")
        places = F.filter(F.sequence(F.lit(0), F.length("payload")), lambda k: k < F.length("payload"))
        values = F.transform(places, lambda k: q.nonlinear_inverse(F.conv(F.substring(text, 2 * k + 1, F.lit(2)), 16, 10).cast("int"), self.points))
        return streams.select("sample_id", values.alias(self.column))


@register("product")
class Product:
    """Tokens normalised, rotated and assigned to codebooks of groups of channels; labels are range coded by group.

    `column` holds a sample's tokens, array<array<double>>. Streams of a sample: `side` (number of tokens, then mean and
    deviation of each statistics group as float32) and `g0`, `g1`, ... With `rate_weight`, -log2 of a word's probability
    divided by it is added to distances. A sample is one task's work; an artifact is refused beyond MAX_CODEBOOK_VALUES.
    """

    def __init__(self, rotation, codebooks, pmf, mode: str = "per_token_ln", prefix: int = 0, rate_weight: float | None = None, column: str = "vec"):
        arrays = {"R": rotation, "codebooks": codebooks, "pmf": pmf}
        found = vq.validate_artifact({k: np.asarray(v, float) for k, v in arrays.items()})
        if found["codebooks"].size > vq.MAX_CODEBOOK_VALUES:
            raise ValueError("codebooks are too large for every worker to hold")
        normalise.check(mode, prefix)
        self.rotation, self.words, self.pmf = found["R"], found["codebooks"], found["pmf"]
        self.mode, self.prefix, self.rate_weight, self.column = mode, prefix, rate_weight, column
        self.tables = [entropy.quantised_cdf(p) for p in self.pmf]

    def parts(self, tokens: int) -> np.ndarray:
        """The statistics group of each token."""
        at = np.arange(tokens)
        if self.mode == "per_token_ln":
            return at
        if self.mode == "per_image":
            return np.zeros(tokens, int)
        first = at < self.prefix if self.mode == "split_cls_patch" else (at >= 1) & (at < self.prefix)
        return np.where(first, 0, 1)

    def labels(self, x: np.ndarray) -> np.ndarray:
        """(groups, tokens): the word of least cost, of equals the lowest."""
        groups, size, width = self.words.shape
        rotated = (x @ self.rotation).reshape(len(x), groups, width)
        out = np.empty((groups, len(x)), int)
        for g in range(groups):
            cost = np.zeros((len(x), size))
            for i in range(width):  # no more than tokens x words at a time
                cost += (rotated[:, g, i, None] - self.words[g, :, i]) ** 2
            if self.rate_weight is not None:
                cost -= np.log2(np.maximum(self.pmf[g], 1e-300)) / self.rate_weight
            out[g] = cost.argmin(axis=1)
        return out

    def write(self, tokens: np.ndarray) -> dict[str, bytes]:
        if tokens.ndim != 2 or tokens.shape[1] != len(self.rotation):
            raise ValueError(f"tokens need {len(self.rotation)} channels")
        part = self.parts(len(tokens))
        n = np.bincount(part) * tokens.shape[1]
        mean = np.bincount(part, tokens.sum(axis=1)) / np.maximum(n, 1)
        spread = np.bincount(part, ((tokens - mean[part, None]) ** 2).sum(axis=1)) / np.maximum(n, 1)
        sigma = np.sqrt(spread + normalise.EPS)
        labels = self.labels((tokens - mean[part, None]) / sigma[part, None])
        side = struct.pack("<I", len(tokens)) + np.stack([mean, sigma], axis=1).astype("<f4").tobytes()
        return {"side": side} | {f"g{g}": entropy.encode(labels[g].tolist(), self.tables[g]) for g in range(len(labels))}

    def read(self, streams: dict[str, bytes]) -> np.ndarray:
        (tokens,) = struct.unpack_from("<I", streams["side"])
        stats = np.frombuffer(streams["side"], "<f4", offset=4).reshape(-1, 2).astype(float)
        part = self.parts(tokens)
        if len(stats) != (part.max() + 1 if tokens else 0):
            raise ValueError("side information doesn't fit")
        words = [self.words[g][entropy.decode(streams[f"g{g}"], tokens, t)] for g, t in enumerate(self.tables)]
        return np.concatenate(words, axis=1) @ self.rotation.T * stats[part, 1:] + stats[part, :1]

    def encode(self, samples: DataFrame) -> DataFrame:
        dims = len(self.rotation)

        @F.pandas_udf("array<struct<stream:string,payload:binary>>")
        def run(column: pd.Series) -> pd.Series:
            return pd.Series([[] if x is None else [{"stream": k, "payload": v} for k, v in self.write(np.array([np.asarray(t, float) for t in x]).reshape(-1, dims)).items()] for x in column])

        return samples.select("sample_id", F.inline(run(F.col(self.column).cast("array<array<double>>"))))

    def decode(self, streams: DataFrame) -> DataFrame:
        names = ["side", *[f"g{g}" for g in range(len(self.tables))]]

        @F.pandas_udf("array<array<double>>")
        def run(column: pd.Series) -> pd.Series:
            return pd.Series([self.read({n: bytes(s) for n, s in zip(names, x)}).tolist() for x in column])

        each = streams.groupBy("sample_id").agg(F.array(*[F.max(F.when(F.col("stream") == n, F.col("payload"))) for n in names]).alias("all"))
        return each.select("sample_id", run("all").alias(self.column))
