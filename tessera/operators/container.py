"""Byte containers: picture units of a coded sequence, and a layered stream with start codes.

Picture units: one header byte (0 parameter set, 1 intra, 2 predicted), then
- of a parameter set: id byte, height and width as variable-length numbers, one byte of flags;
- of a picture: id byte of its parameter set, qp byte, variable-length size, payload.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPS, INTRA, PREDICTED = 0, 1, 2
START = b"\x00\x00\x01"


def put_number(n: int) -> bytes:
    """1, 2 or 4 bytes with prefix bits 0, 10, 11."""
    if not 0 <= n < 1 << 30:
        raise ValueError("number out of range")
    if n < 1 << 7:
        return n.to_bytes(1, "big")
    return (n | 2 << 14).to_bytes(2, "big") if n < 1 << 14 else (n | 3 << 30).to_bytes(4, "big")


def get_number(data: bytes, at: int) -> tuple[int, int]:
    """The number and the place after it."""
    if at >= len(data):
        raise ValueError("cut off")
    size = (1, 1, 2, 4)[data[at] >> 6]
    if at + size > len(data):
        raise ValueError("cut off")
    return int.from_bytes(data[at : at + size], "big") & ((1 << 8 * size - (1 if size == 1 else 2)) - 1), at + size


@dataclass(frozen=True)
class Picture:
    intra: bool
    qp: int
    payload: bytes
    height: int
    width: int
    flags: int = 0


def write_sequence(pictures: Iterable[Picture]) -> bytes:
    """Parameter sets are written once, where they are first used."""
    known: dict[tuple[int, int, int], int] = {}
    out = bytearray()
    for p in pictures:
        key = (p.height, p.width, p.flags)
        if key not in known:
            if len(known) == 256:
                raise ValueError("too many parameter sets")
            known[key] = len(known)
            out += bytes((SPS, known[key])) + put_number(p.height) + put_number(p.width) + bytes((p.flags,))
        out += bytes((INTRA if p.intra else PREDICTED, known[key], p.qp)) + put_number(len(p.payload)) + p.payload
    return bytes(out)


def read_sequence(data: bytes) -> Iterator[Picture]:
    known: dict[int, tuple[int, int, int]] = {}
    at = 0
    while at < len(data):
        kind = data[at]
        if at + 1 >= len(data) or kind > PREDICTED:
            raise ValueError("no unit here")
        number, at = data[at + 1], at + 2
        if kind == SPS:
            height, at = get_number(data, at)
            width, at = get_number(data, at)
            if at >= len(data):
                raise ValueError("cut off")
            known[number], at = (height, width, data[at]), at + 1
            continue
        if number not in known or at >= len(data):
            raise ValueError("picture without a parameter set, or cut off")
        qp, at = data[at], at + 1
        size, at = get_number(data, at)
        if at + size > len(data):
            raise ValueError("cut off")
        height, width, flags = known[number]
        yield Picture(kind == INTRA, qp, data[at : at + size], height, width, flags)
        at += size


def _escape(data: bytes) -> bytes:
    """No start code appears in a body: a 3 goes after two zeros before anything up to 3. Bodies end in 0x80."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def _unescape(data: bytes) -> bytes:
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def write_layers(layers: Iterable[tuple[int, bytes, bytes | None]]) -> bytes:
    """Layers (id, payload, extension or none): start code, id, flag of an extension, its length and bytes, payload."""
    out = bytearray()
    for number, payload, extension in layers:
        body = bytes((number, 0 if extension is None else 1)) + (b"" if extension is None else put_number(len(extension)) + extension) + payload
        out += START + _escape(body + b"\x80")
    return bytes(out)


def read_layers(data: bytes) -> list[tuple[int, bytes, bytes | None]]:
    if data and not data.startswith(START):
        raise ValueError("no start code")
    out = []
    for part in data.split(START)[1:]:
        body = _unescape(part)
        if len(body) < 3 or body[-1] != 0x80:
            raise ValueError("cut off")
        number, flag, at, extension = body[0], body[1], 2, None
        if flag:
            size, at = get_number(body, at)
            if at + size > len(body) - 1:
                raise ValueError("cut off")
            extension, at = body[at : at + size], at + size
        out.append((number, body[at:-1], extension))
    return out


def sequences(frames: DataFrame) -> DataFrame:
    """(sequence, stream) of frames (sequence, frame_idx, kind, qp, payload, h, w): a sequence is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("frame_idx").itertuples()
        stream = write_sequence(Picture(r.kind == "I", int(r.qp), bytes(r.payload), int(r.h), int(r.w)) for r in rows)
        return pd.DataFrame({"sequence": [pdf["sequence"].iloc[0]], "stream": [stream]})

    return frames.select("sequence", "frame_idx", "kind", "qp", "payload", "h", "w").groupBy("sequence").applyInPandas(run, "sequence long, stream binary")


def pictures(streams: DataFrame) -> DataFrame:
    """(sequence, frame_idx, kind, qp, bytes, h, w) of streams (sequence, stream)."""

    @F.pandas_udf("array<struct<kind: string, qp: int, bytes: int, h: int, w: int>>")
    def parse(column: pd.Series) -> pd.Series:
        return column.map(lambda s: [{"kind": "I" if p.intra else "P", "qp": p.qp, "bytes": len(p.payload), "h": p.height, "w": p.width} for p in read_sequence(bytes(s))])

    return streams.select("sequence", F.posexplode(parse("stream")).alias("frame_idx", "p")).select("sequence", "frame_idx", "p.*")
