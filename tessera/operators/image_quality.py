"""Image quality on one channel (luma): multi-scale structural similarity and gradient magnitude deviation.

Images are flat arrays in row order with their height and width; each pair is judged by itself in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published definitions.
WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
WINDOW, SIGMA, K1, K2 = 11, 1.5, 0.01, 0.03
GRADIENT_CONSTANT = 170.0
SMALLEST = 161  # five scales of 11 pixels


def gaussian(size: int = WINDOW, sigma: float = SIGMA) -> np.ndarray:
    at = np.arange(size) - (size - 1) / 2
    e = np.exp(-(at**2) / (2 * sigma**2))
    return e / e.sum()


def _blurred(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Both axes in turn, without borders."""
    rows = np.lib.stride_tricks.sliding_window_view(x, len(kernel), axis=0) @ kernel
    return np.lib.stride_tricks.sliding_window_view(rows, len(kernel), axis=1) @ kernel


def _halved(x: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 pixels; an odd size gets a border of zeros on both sides of that axis first."""
    x = np.pad(x, [(x.shape[0] % 2,) * 2, (x.shape[1] % 2,) * 2])
    x = x[: x.shape[0] // 2 * 2, : x.shape[1] // 2 * 2]
    return (x[::2, ::2] + x[1::2, ::2] + x[::2, 1::2] + x[1::2, 1::2]) / 4


def ms_ssim_of(a: np.ndarray, b: np.ndarray, peak: float = 1.0) -> float:
    """Images smaller than 161 x 161 are padded with zeros below and at the right; a negative contrast term counts as 0."""
    if a.shape != b.shape:
        raise ValueError("images differ in size")
    more = [(0, max(0, SMALLEST - n)) for n in a.shape]
    a, b, kernel = np.pad(a, more), np.pad(b, more), gaussian()
    c1, c2, out = (K1 * peak) ** 2, (K2 * peak) ** 2, 1.0
    for level, weight in enumerate(WEIGHTS):
        ma, mb = _blurred(a, kernel), _blurred(b, kernel)
        va, vb, both = _blurred(a * a, kernel) - ma * ma, _blurred(b * b, kernel) - mb * mb, _blurred(a * b, kernel) - ma * mb
        contrast = (2 * both + c2) / (va + vb + c2)
        last = level == len(WEIGHTS) - 1
        term = ((2 * ma * mb + c1) / (ma * ma + mb * mb + c1) * contrast if last else contrast).mean()
        out *= max(float(term), 0.0) ** weight
        a, b = (a, b) if last else (_halved(a), _halved(b))
    return out


def gmsd_of(a: np.ndarray, b: np.ndarray, peak: float = 1.0) -> float:
    """Standard deviation (by n - 1) of the similarity of gradients, on means of 2 x 2 pixels at a scale of 255."""
    if a.shape != b.shape:
        raise ValueError("images differ in size")
    if min(a.shape) < 4:
        raise ValueError("an image needs 4 x 4 pixels or more")

    def gradient(x: np.ndarray) -> np.ndarray:
        x = np.pad(_halved(x[: x.shape[0] // 2 * 2, : x.shape[1] // 2 * 2]) * (255 / peak), 1)
        down, across = x[:-2] + x[1:-1] + x[2:], x[:, :-2] + x[:, 1:-1] + x[:, 2:]
        return np.hypot((down[:, 2:] - down[:, :-2]) / 3, (across[2:] - across[:-2]) / 3)

    ga, gb = gradient(a), gradient(b)
    return float(np.std((2 * ga * gb + GRADIENT_CONSTANT) / (ga * ga + gb * gb + GRADIENT_CONSTANT), ddof=1))


def _judged(measure, a: Column | str, b: Column | str, h: Column | str, w: Column | str, peak: float) -> Column:
    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
        found = []
        for x, y, i, j in zip(left, right, rows, columns):
            if x is None or y is None or pd.isna(i) or pd.isna(j):
                found.append(None)
            else:
                found.append(measure(np.asarray(x, float).reshape(int(i), int(j)), np.asarray(y, float).reshape(int(i), int(j)), peak))
        return pd.Series(found, dtype="float64")

    return run(a, b, h, w)


def ms_ssim(a: Column | str, b: Column | str, h: Column | str, w: Column | str, peak: float = 1.0) -> Column:
    return _judged(ms_ssim_of, a, b, h, w, peak)


def gmsd(a: Column | str, b: Column | str, h: Column | str, w: Column | str, peak: float = 1.0) -> Column:
    return _judged(gmsd_of, a, b, h, w, peak)
