"""Image arrays (flat, height x width x channels) through numpy in Arrow batches. Random choices follow a seed and the sample's id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "values array<float>, h int, w int, c int"


def _apply(step: Callable[[np.ndarray, np.random.Generator | None], np.ndarray], image: Column, key: Column | None, seed: int) -> Column:
    """A transform as a column; image is a struct (values, h, w, c)."""

    @F.pandas_udf(IMAGE)
    def run(frame: pd.DataFrame, keys: pd.Series) -> pd.DataFrame:
        out = []
        for values, h, w, c, k in zip(frame["values"], frame["h"], frame["w"], frame["c"], keys):
            x = np.asarray(values, np.float32).reshape(h, w, c)
            y = np.ascontiguousarray(step(x, np.random.default_rng([seed, int(k)])), np.float32)
            out.append((y.ravel(), *y.shape))
        return pd.DataFrame(out, columns=["values", "h", "w", "c"])

    return run(image, F.lit(0).cast("long") if key is None else F.abs(key.cast("long")))


def pad_to(x: np.ndarray, h: int, w: int, fill: float) -> np.ndarray:
    """Content in the middle of at least h x w, the smaller half of the border first."""
    dh, dw = max(0, h - x.shape[0]), max(0, w - x.shape[1])
    return np.pad(x, ((dh // 2, dh - dh // 2), (dw // 2, dw - dw // 2), (0, 0)), constant_values=fill)


def bilinear(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Resized with pixel centres at halves, as is usual without aligned corners."""

    def axis(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    (y0, y1, fy), (x0, x1, fx) = axis(x.shape[0], h), axis(x.shape[1], w)
    rows = x[y0] * (1 - fy)[:, None, None] + x[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def nearest(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """For labels: no values in between."""
    return x[np.arange(h) * x.shape[0] // h][:, np.arange(w) * x.shape[1] // w]


def padded(image: Column, h: int, w: int, fill: float = 0.0) -> Column:
    return _apply(lambda x, _: pad_to(x, h, w, fill), image, None, 0)


def padded_to_multiple(image: Column, multiple: int, fill: float = 0.0) -> Column:
    up = lambda n: -(-n // multiple) * multiple
    return _apply(lambda x, _: pad_to(x, up(x.shape[0]), up(x.shape[1]), fill), image, None, 0)


def resized(image: Column, h: int, w: int, labels: bool = False) -> Column:
    return _apply(lambda x, _: (nearest if labels else bilinear)(x, h, w), image, None, 0)


def centre_cropped(image: Column, h: int, w: int) -> Column:
    def step(x, _):
        top, left = max(0, (x.shape[0] - h) // 2), max(0, (x.shape[1] - w) // 2)
        return x[top : top + h, left : left + w]

    return _apply(step, image, None, 0)


def roi(image: Column, top: Column, left: Column, height: Column, width: Column) -> Column:
    """The region of a padded image, without Python: rows of the flat array."""
    w, c = image["w"], image["c"]
    rows = F.transform(F.sequence(F.lit(0), height - 1), lambda r: F.slice(image["values"], ((top + r) * w + left) * c + 1, width * c))
    return F.struct(F.flatten(rows).alias("values"), height.alias("h"), width.alias("w"), c.alias("c"))


def normalised(image: Column, mean: tuple[float, ...], std: tuple[float, ...]) -> Column:
    """(x - mean) / std by channel, without Python."""
    m, s, n = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std)), len(mean)
    values = F.transform(image["values"], lambda x, k: ((x - F.get(m, F.pmod(k, F.lit(n)))) / F.get(s, F.pmod(k, F.lit(n)))).cast("float"))
    return image.withField("values", values)


def channels_first(image: Column) -> Column:
    """Values in the order channel, row, column."""
    c, n = image["c"], F.size(image["values"])
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), c - 1), lambda k: F.filter(image["values"], lambda _, i: F.pmod(i, c) == k)))).otherwise(image["values"])


def flipped(image: Column, key: Column, seed: int = 0, chance: float = 0.5) -> Column:
    return _apply(lambda x, rng: x[:, ::-1] if rng.random() < chance else x, image, key, seed)


def random_cropped(image: Column, h: int, w: int, key: Column, seed: int = 0) -> Column:
    """A crop of at most h x w at a place drawn by the seed and the key."""

    def step(x, rng):
        top, left = rng.integers(0, max(1, x.shape[0] - h + 1)), rng.integers(0, max(1, x.shape[1] - w + 1))
        return x[top : top + h, left : left + w]

    return _apply(step, image, key, seed)


def random_scaled(image: Column, low: float, high: float, key: Column, seed: int = 0, labels: bool = False) -> Column:
    def step(x, rng):
        s = rng.uniform(low, high)
        return (nearest if labels else bilinear)(x, max(1, round(x.shape[0] * s)), max(1, round(x.shape[1] * s)))

    return _apply(step, image, key, seed)


def distorted(image: Column, key: Column, seed: int = 0, brightness: float = 32.0, contrast: tuple[float, float] = (0.5, 1.5)) -> Column:
    """Brightness and contrast of 0..255 images, drawn by the seed and the key, cut to the range."""
    return _apply(lambda x, rng: np.clip(x * rng.uniform(*contrast) + rng.uniform(-brightness, brightness), 0, 255), image, key, seed)


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two images of one shape, without Python."""
    d = F.zip_with(a["values"], b["values"], lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(a["values"])
