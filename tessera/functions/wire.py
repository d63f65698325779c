"""Values as raw bytes of the wire types: float16, bfloat16, float8 (e4m3fn, e5m2). Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM_BYTES = {"float16": 2, "bfloat16": 2, "float8_e4m3fn": 1, "float8_e5m2": 1, "float32": 4}


def _float8_values(kind: str) -> np.ndarray:
    """What each byte stands for, by the rule of the type."""
    exponent_bits, bias = (4, 7) if kind == "float8_e4m3fn" else (5, 15)
    mantissa_bits = 7 - exponent_bits
    out = np.empty(256)
    for b in range(256):
        sign, e, m = -1.0 if b >> 7 else 1.0, b >> mantissa_bits & (1 << exponent_bits) - 1, b & (1 << mantissa_bits) - 1
        fraction = m / (1 << mantissa_bits)
        out[b] = sign * (fraction * 2.0 ** (1 - bias) if e == 0 else (1 + fraction) * 2.0 ** (e - bias))
        if kind == "float8_e4m3fn" and b & 127 == 127:
            out[b] = np.nan
        if kind == "float8_e5m2" and e == 31:
            out[b] = sign * np.inf if m == 0 else np.nan
    return out


def to_bytes(values: np.ndarray, kind: str) -> bytes:
    """Nearest values, ties to even; e4m3fn has no infinity, so what is too large becomes nan."""
    x = np.asarray(values, np.float32)
    if kind == "float32":
        return x.astype("<f4").tobytes()
    if kind == "float16":
        return x.astype("<f2").tobytes()
    if kind == "bfloat16":
        bits = x.view(np.uint32)
        rounded = (bits + 0x7FFF + (bits >> 16 & 1)) >> 16
        return np.where(np.isnan(x), 0x7FC0, rounded).astype("<u2").tobytes()
    table = _float8_values(kind)
    order = np.array([b for b in range(128) if np.isfinite(table[b])])
    known, size = table[order], np.abs(x.astype(np.float64))
    k = np.clip(np.searchsorted(known, size), 1, len(known) - 1)
    low, high = known[k - 1], known[k]
    up = (size - low > high - size) | ((size - low == high - size) & (order[k] % 2 == 0))
    code = np.where(up, order[k], order[k - 1])
    limit = known[-1] + (known[-1] - known[-2]) / 2
    code = np.where(size >= limit if kind == "float8_e5m2" else size > limit, 127 if kind == "float8_e4m3fn" else 0x7C, code)
    code = np.where(np.isnan(x), 127, code) | np.where(np.signbit(x), 128, 0)
    return code.astype(np.uint8).tobytes()


def from_bytes(data: bytes, kind: str) -> np.ndarray:
    if kind == "float32":
        return np.frombuffer(data, "<f4")
    if kind == "float16":
        return np.frombuffer(data, "<f2").astype(np.float32)
    if kind == "bfloat16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    return _float8_values(kind)[np.frombuffer(data, np.uint8)].astype(np.float32)


def encode(values: Column, kind: str) -> Column:
    """An array of values as bytes."""
    if kind not in ITEM_BYTES:
        raise ValueError(f"unknown wire type {kind!r}")

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else to_bytes(v, kind))

    return run(values)


def decode(payload: Column, kind: str) -> Column:
    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else from_bytes(v, kind))

    return run(payload)


def bits(values: Column, kind: str) -> Column:
    """Arithmetic only: values times the bits of one."""
    return (F.size(values) * ITEM_BYTES[kind] * 8).cast("long")
