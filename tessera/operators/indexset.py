"""Bounded index sets: the shorter of a bitmap and a list of fixed-width indices, as self-contained streams.

Stream: 4 bytes BIS1, one byte of coding (0 bitmap, 1 index), universe and count as big-endian 32-bit
numbers, payload. Bitmaps start with the lowest bit of a byte, index lists with the highest.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stream format.
HEADER = struct.Struct(">4sBII")
MAGIC = b"BIS1"
CODINGS = ("bitmap", "index")


def width_of(universe: int) -> int:
    return max(1, (universe - 1).bit_length())


def validate(indices: Iterable[int], universe: int) -> list[int]:
    found = sorted(map(int, indices))
    if universe <= 0 or found and not 0 <= found[0] <= found[-1] < universe:
        raise ValueError("indices outside of the universe")
    if len(set(found)) < len(found):
        raise ValueError("indices repeat")
    return found


def payload_size(coding: str, count: int, universe: int) -> int:
    return -(-universe // 8) if coding == "bitmap" else -(-count * width_of(universe) // 8)


def encode(indices: Iterable[int], universe: int) -> bytes:
    found = validate(indices, universe)
    coding = "index" if payload_size("index", len(found), universe) < payload_size("bitmap", 0, universe) else "bitmap"
    size = payload_size(coding, len(found), universe)
    if coding == "bitmap":
        marks = np.zeros(8 * size, np.uint8)
        marks[found] = 1
        payload = np.packbits(marks, bitorder="little").tobytes()
    else:
        shifts = np.arange(width_of(universe) - 1, -1, -1)
        payload = np.packbits((np.array(found, np.int64)[:, None] >> shifts & 1).astype(np.uint8)).tobytes()
    return HEADER.pack(MAGIC, CODINGS.index(coding), universe, len(found)) + payload


def decode(stream: bytes) -> tuple[list[int], int, str]:
    """Indices, universe and coding of a stream; whatever isn't exactly such a stream is a ValueError."""
    if len(stream) < HEADER.size:
        raise ValueError("stream cut off")
    magic, kind, universe, count = HEADER.unpack_from(stream)
    if magic != MAGIC:
        raise ValueError("no index-set stream")
    if kind >= len(CODINGS):
        raise ValueError("unknown coding")
    payload, coding = stream[HEADER.size :], CODINGS[kind]
    if universe <= 0 or count > universe or len(payload) != payload_size(coding, count, universe):
        raise ValueError("length doesn't fit")
    if coding == "bitmap":
        found = np.flatnonzero(np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little")).tolist()
    else:
        width = width_of(universe)
        bits = np.unpackbits(np.frombuffer(payload, np.uint8)).astype(np.int64)
        if bits[width * count :].any():
            raise ValueError("padding isn't zero")
        found = (bits[: width * count].reshape(count, width) @ (1 << np.arange(width - 1, -1, -1))).tolist()
    if len(validate(found, universe)) != count:
        raise ValueError("count doesn't fit")
    return found, universe, coding


def encode_column(indices: Column | str, universe: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(i: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encode(x, int(n)) for x, n in zip(i, u)])

    return run(indices, universe)


def decode_column(stream: Column | str) -> Column:
    @F.pandas_udf("array<int>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda s: None if s is None else decode(bytes(s))[0])

    return run(stream)


def status_column(stream: Column | str) -> Column:
    """`ok`, or what is wrong with a stream."""

    def status(s) -> str:
        try:
            decode(bytes(s))
        except ValueError as e:
            return str(e)
        return "ok"

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda s: "missing" if s is None else status(s))

    return run(stream)


def is_valid(indices: Column, universe: Column) -> Column:
    """In range and without repeats, without Python."""
    inside = F.forall(indices, lambda i: (i >= 0) & (i < universe))
    return (universe > 0) & inside & (F.size(F.array_distinct(indices)) == F.size(indices))
