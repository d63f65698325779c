"""Product and entropy-constrained vector quantisation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V

MAX_CODEBOOK_VALUES = 50_000_000


def grouped(vectors: DataFrame, groups: int, width: int, vec: str = "vec") -> DataFrame:
    """A row for each group of a vector: the columns besides vec, g, part."""
    others = [c for c in vectors.columns if c != vec]
    return vectors.select(*others, F.posexplode(V.slices(F.col(vec), groups, width)).alias("g", "part"))


def codebook_arrays(codebook: DataFrame) -> DataFrame:
    """A row for each group with its codewords in order of k, from rows (g, k, vec) and rates if there are any."""
    fields = ["k", "vec"] + (["rate"] if "rate" in codebook.columns else [])
    return codebook.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("words"))


def assign(parts: DataFrame, codebook: DataFrame, rate_weight: float | None = None) -> DataFrame:
    """Adds label and cost: the codeword nearest to each part, of equals the lowest.

    With `rate_weight`, rates of the codebook divided by it are added to distances. A codebook is a model
    of fixed size: it is counted, and refused beyond MAX_CODEBOOK_VALUES, before it is broadcast.
    """
    values = codebook.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]
    if values > MAX_CODEBOOK_VALUES:
        raise ValueError(f"a codebook of {values} values is too large to broadcast")
    joined = parts.join(F.broadcast(codebook_arrays(codebook)), "g")

    def cost(word: Column) -> Column:
        d = V.squared_distance(F.col("part"), word["vec"])
        return d if rate_weight is None else d + word["rate"] / rate_weight

    best = F.array_min(F.transform("words", lambda w: F.struct(cost(w).alias("cost"), w["k"].alias("k"))))
    return joined.withColumn("best", best).select(*parts.columns, F.col("best.k").alias("label"), F.col("best.cost").alias("cost"))


def kmeans(parts: DataFrame, codebook: DataFrame, rounds: int, tolerance: float = 1e-4) -> DataFrame:
    """Lloyd's rounds from a given codebook; a word without members stays. Stops when the words' largest shift by group is small."""
    words = codebook
    for _ in range(rounds):
        found = assign(parts, words)
        means = found.select("g", "label", F.posexplode("part").alias("i", "x")).groupBy("g", "label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        arrays = means.groupBy("g", F.col("label").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("after"))
        joined = words.join(arrays, ["g", "k"], "left").select("g", "k", F.coalesce("after", F.transform("vec", lambda x: x.cast("double"))).alias("vec"), F.col("vec").alias("before"))
        rows = joined.collect()  # a codebook: bounded by its check in assign
        shift: dict[int, float] = {}
        for r in rows:
            shift[r.g] = shift.get(r.g, 0.0) + float(np.sum((np.array(r.vec) - np.array(r.before)) ** 2))
        words = parts.sparkSession.createDataFrame([(r.g, r.k, [float(x) for x in r.vec]) for r in rows], "g int, k int, vec array<double>")
        if max(shift.values(), default=0.0) ** 0.5 < tolerance:
            break
    return words


def histogram_pmf(labels: DataFrame, symbols: int, floor: float = 1e-7) -> DataFrame:
    """(g, label, n, p): counts raised to the floor, then made to sum to 1; absent labels are there."""
    counts = labels.groupBy("g", "label").agg(F.count("*").alias("n"))
    grid = labels.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(symbols - 1))).alias("label"))
    dense = grid.join(counts, ["g", "label"], "left").select("g", "label", F.coalesce("n", F.lit(0)).alias("n"))
    raised = dense.withColumn("f", F.greatest(F.col("n").cast("double"), F.lit(floor)))
    total = raised.groupBy("g").agg(F.sum("f").alias("total"))
    return raised.join(total, "g").select("g", "label", "n", (F.col("f") / F.col("total")).alias("p"))


def smoothed_prior(labels: DataFrame, symbols: int) -> DataFrame:
    """(g, label, p) with one added to each count."""
    pmf = histogram_pmf(labels, symbols)
    total = pmf.groupBy("g").agg(F.sum("n").alias("total"))
    return pmf.join(total, "g").select("g", "label", ((F.col("n") + 1) / (F.col("total") + symbols)).alias("p"))


def mixed_prior(pmf: DataFrame, floor: float, symbols: int) -> DataFrame:
    """A prior with a share `floor` of the uniform one mixed in, and the rate of each label in bits."""
    p = (1 - floor) * F.col("p") + floor / symbols
    return pmf.withColumn("p", p).withColumn("rate", -F.log2("p"))


def padded_rows(vectors: DataFrame, width: int, vec: str = "vec") -> DataFrame:
    """Vectors filled up with zeros to a multiple of `width`."""
    short = F.pmod(-F.size(vec), F.lit(width))
    return vectors.withColumn(vec, F.concat(F.transform(vec, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), short)))


def perplexity(pmf: DataFrame) -> DataFrame:
    """Mean over groups of exp(entropy), and the number of words never used."""
    each = pmf.groupBy("g").agg(F.exp(-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("e"), F.sum((F.col("n") == 0).cast("int")).alias("dead"))
    return each.agg(F.avg("e").alias("perplexity"), F.sum("dead").alias("dead"))


def validate_artifact(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Checks rotation R, codebooks and pmf, and makes pmf rows sum to 1."""
    for name in ("R", "codebooks", "pmf"):
        if name not in arrays:
            raise KeyError(name)
        if not np.isfinite(arrays[name]).all():
            raise ValueError(f"{name} isn't finite")
    r, words, pmf = arrays["R"], arrays["codebooks"], arrays["pmf"]
    if words.ndim != 3 or pmf.shape != words.shape[:2] or r.shape != (words.shape[0] * words.shape[2],) * 2:
        raise ValueError("shapes don't fit")
    if (pmf < 0).any() or (pmf.sum(axis=1) <= 0).any():
        raise ValueError("pmf needs mass and no negative values")
    return arrays | {"pmf": pmf / pmf.sum(axis=1, keepdims=True)}


def codebook_table(spark, words: np.ndarray, pmf: np.ndarray | None = None) -> DataFrame:
    rows = [(g, k, [float(x) for x in words[g, k]], float(-np.log2(max(pmf[g, k], 1e-300))) if pmf is not None else 0.0) for g in range(words.shape[0]) for k in range(words.shape[1])]
    return spark.createDataFrame(rows, "g int, k int, vec array<double>, rate double")


def rotate(vectors: DataFrame, rotation: np.ndarray, vec: str = "vec") -> DataFrame:
    """Rows times a matrix, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(column.to_list()).astype(float) @ rotation)) if len(column) else column

    return vectors.withColumn(vec, run(vec))


def moments(vectors: DataFrame, dims: int, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (by N): partial sums of each Arrow batch, one row of dims^2 a batch, summed by cell."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = np.stack([np.asarray(v.values, float) for v in batch.column(0)]) if batch.num_rows else np.zeros((0, dims))
            cells = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

    rows = vectors.select(vec).mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    cells = np.zeros(1 + dims + dims * dims)
    for r in rows:
        cells[r.cell] = r.value
    n = int(cells[0])
    mean = cells[1 : 1 + dims] / max(n, 1)
    return n, mean, cells[1 + dims :].reshape(dims, dims) / max(n, 1) - np.outer(mean, mean)


def pca_rotation(covariance: np.ndarray, groups: int) -> np.ndarray:
    """Eigenvectors by falling eigenvalue, dealt out to groups in turn: group g gets those of rank g, g + groups, ..."""
    width = len(covariance) // groups
    values, vectors = np.linalg.eigh(covariance)
    vectors = vectors[:, np.argsort(-values, kind="stable")]
    order = [g + k * groups for g in range(groups) for k in range(width)]
    return vectors[:, order]


def procrustes(cross: np.ndarray) -> np.ndarray:
    """The rotation nearest to a cross-covariance, with determinant 1."""
    u, _, vt = np.linalg.svd(cross)
    if np.linalg.det(u @ vt) < 0:
        u[:, -1] *= -1
    return u @ vt


def learn_rotation(vectors: DataFrame, groups: int, words: int, rounds: int = 5, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, float]:
    """Alternates product quantisation and Procrustes steps; the best rotation, its codebooks and its mean squared error.

    The first words are the vectors of the smallest hashes, so a run can be repeated. Sums run over all vectors; only dims^2 numbers and the codebooks come to the driver.
    """
    import pyarrow as pa

    dims = len(vectors.select(vec).first()[0])
    width = dims // groups
    _, _, covariance = moments(vectors, dims, vec)
    rotation = pca_rotation(covariance, groups)
    first = np.array([r[0] for r in vectors.select(vec).orderBy(F.xxhash64(vec), vec).limit(words).collect()], float)
    best, last = (rotation, first, np.inf), np.inf
    for step in range(rounds):
        turned = rotate(vectors.select(F.col(vec).alias("vec")), rotation)
        start = (first @ rotation).reshape(len(first), groups, width).transpose(1, 0, 2)
        table = kmeans(grouped(turned, groups, width), codebook_table(vectors.sparkSession, start).drop("rate"), 3)
        book = np.zeros_like(start)
        for r in table.collect():
            book[r.g, r.k] = r.vec

        def run(batches, rotation=rotation, book=book):
            for batch in batches:
                x = np.stack([np.asarray(v.values, float) for v in batch.column(0)]) if batch.num_rows else np.zeros((0, dims))
                parts = (x @ rotation).reshape(len(x), groups, width)
                near = np.concatenate([book[g][((parts[:, g, None] - book[g][None]) ** 2).sum(-1).argmin(1)] for g in range(groups)], axis=1)
                cells = np.concatenate([[len(x), ((x @ rotation - near) ** 2).sum()], (x.T @ near).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

        rows = vectors.select(vec).mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        cells = np.zeros(2 + dims * dims)
        for r in rows:
            cells[r.cell] = r.value
        error = cells[1] / max(cells[0], 1) / dims
        if error < best[2]:
            best = (rotation, book, error)
        if step and abs(last - error) < 1e-8:
            break
        last, rotation = error, procrustes(cells[2:].reshape(dims, dims))
    return best


def cayley(skew: np.ndarray) -> np.ndarray:
    """(I - A)^-1 (I + A) of the skew part of a matrix: a rotation."""
    a = (skew - skew.T) / 2
    one = np.eye(len(a))
    return np.linalg.solve(one - a, one + a)


def reconstruct(found: DataFrame, codebook: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, vec) from labels (keys, g, label)."""
    words = F.broadcast(codebook.select("g", F.col("k").alias("label"), F.col("vec").alias("word")))
    rows = found.join(words, ["g", "label"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("g", "word"))).alias("w"))
    return rows.select(*keys, F.flatten(F.transform("w", lambda s: s["word"])).alias("vec"))
