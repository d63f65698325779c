"""Code strings, sizes of integer codes, sizes of index sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _binary(x: Column, width: Column) -> Column:
    """x in `width` binary digits; none for width 0."""
    return F.when(width <= 0, F.lit("")).otherwise(F.lpad(F.bin(x), width, "0"))


def unary(x: Column) -> Column:
    return F.concat(F.repeat(F.lit("1"), x.cast("int")), F.lit("0"))


def fixed_length(x: Column, width: int) -> Column:
    return _binary(x, F.lit(width))


def truncated_binary(x: Column, n: int) -> Column:
    """Code of x in [0, n): short words first."""
    width = n.bit_length()
    short = 2**width - n
    return F.when(x < short, _binary(x, F.lit(width - 1))).otherwise(_binary(x + short, F.lit(width)))


def rice(x: Column, k: int) -> Column:
    """Unary quotient by 2^k and k bits of remainder: the textbook code, whose round trip holds."""
    quotient = F.floor(x / (1 << k)).cast("long")
    return F.concat(unary(quotient), _binary(x - quotient * (1 << k), F.lit(k)))


def exp_golomb(x: Column, k: int = 0) -> Column:
    digits = F.bin(x + (1 << k))
    return F.concat(F.repeat(F.lit("0"), F.length(digits) - k - 1), digits)


def signed_exp_golomb(x: Column, k: int = 0) -> Column:
    """Negative x goes to -2x - 1, others to 2x; k is honoured."""
    return exp_golomb(F.when(x < 0, -2 * x - 1).otherwise(2 * x), k)


def varint_size(x: Column) -> Column:
    """Bytes of the 1, 2 or 4 byte code with prefix bits 0, 10, 11; null beyond 30 bits."""
    return F.when(x < 1 << 7, 1).when(x < 1 << 14, 2).when(x < 1 << 30, 4)


def varint_hex(x: Column) -> Column:
    """The bytes of that code, as hex."""
    size = varint_size(x)
    value = F.when(size == 1, x).when(size == 2, x + (2 << 14)).when(size == 4, x + (3 << 30))
    return F.lower(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def index_width(universe: Column) -> Column:
    """Bits of one index: max(1, ceil(log2 universe)), in integers."""
    return F.greatest(F.lit(1), F.length(F.bin(universe - 1)))


def index_payload_size(count: Column, universe: Column) -> Column:
    return F.ceil(count * index_width(universe) / 8).cast("long")


def bitmap_payload_size(universe: Column) -> Column:
    return F.ceil(universe / 8).cast("long")


def index_coding(count: Column, universe: Column) -> Column:
    """`index` only where it is shorter than the bitmap."""
    return F.when(index_payload_size(count, universe) < bitmap_payload_size(universe), "index").otherwise("bitmap")
