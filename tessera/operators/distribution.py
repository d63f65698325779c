"""Distances between distributions of features, from their moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.operators.vq import moments


def frechet(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """Squared Frechet distance of two Gaussians; the root of the product by eigenvalues of a symmetric form."""
    values, vectors = np.linalg.eigh(cov_a)
    root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cov_b @ root), 0, None)).sum()
    return float(((mean_a - mean_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * cross)


def feature_distance(a: DataFrame, b: DataFrame, dims: int, vec: str = "vec") -> float:
    """Over two tables of features; sums run on the executors, dims^2 numbers come to the driver. Covariances by N - 1."""
    (n, mean_a, cov_a), (m, mean_b, cov_b) = moments(a, dims, vec), moments(b, dims, vec)
    if min(n, m) < 2:
        raise ValueError("a distribution needs two rows")
    return frechet(mean_a, cov_a * n / (n - 1), mean_b, cov_b * m / (m - 1))
