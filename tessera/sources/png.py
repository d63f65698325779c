"""PNG files of 8 bits a channel, not interlaced, by zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type; a palette's indices are one channel


def decode(data: bytes) -> np.ndarray:
    """[h, w, c] bytes; palettes are looked up."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, packed, palette, head = 8, [], None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        raise ValueError("only 8 bits a channel, not interlaced")
    w, h, c = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.uint8)
    for y in range(h):
        above = out[y] = _unfilter(raw[y, 0], raw[y, 1:], above, c)
    found = out.reshape(h, w, c)
    return palette[found[:, :, 0]] if head[3] == 3 and palette is not None else found


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, c: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, c), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError("unknown filter")
    out, up = [0] * len(line), above.tolist()
    for k, v in enumerate(line.tolist()):
        a, b, d = (out[k - c], up[k], up[k - c]) if k >= c else (0, up[k], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - d
            pa, pb, pd_ = abs(p - a), abs(p - b), abs(p - d)
            guess = a if pa <= pb and pa <= pd_ else b if pb <= pd_ else d
        out[k] = (v + guess) & 255
    return np.array(out, np.uint8)


def encode(image: np.ndarray) -> bytes:
    """A PNG file of [h, w, c] bytes, c of 1 to 4."""
    h, w, c = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * c).astype(np.uint8)], axis=1)
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def images(spark: SparkSession, path: str, scale: float = 1 / 255) -> DataFrame:
    """(path, image) of the PNG files below a folder; an image is a struct (values, h, w, c)."""

    @F.pandas_udf("values array<float>, h int, w int, c int")
    def load(content: pd.Series) -> pd.DataFrame:
        found = [decode(bytes(data)) for data in content]
        return pd.DataFrame([((x.astype(np.float32) * scale).ravel(), *x.shape) for x in found], columns=["values", "h", "w", "c"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    return rows.select("path", load("content").alias("image"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, frame_idx, path, image): the files of each folder in order of name."""
    from pyspark.sql import Window

    rows = images(spark, path).withColumn("sequence", F.element_at(F.split("path", "/"), -2))
    return rows.withColumn("frame_idx", F.row_number().over(Window.partitionBy("sequence").orderBy("path")) - 1).select("sequence", "frame_idx", "path", "image")
