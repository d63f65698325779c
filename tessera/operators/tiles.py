"""Feature planes as tiles, uniform index streams, complexity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiled_place(channel: Column, y: Column, x: Column, h: int, w: int, columns: int) -> tuple[Column, Column]:
    """Row and column of a channel's value in one plane of tiles, `columns` of them side by side."""
    return F.floor(channel / columns) * h + y, F.pmod(channel, F.lit(columns)) * w + x


def untiled_place(row: Column, column: Column, h: int, w: int, columns: int) -> tuple[Column, Column, Column]:
    """(channel, y, x) of a place in the plane."""
    return F.floor(row / h) * columns + F.floor(column / w), F.pmod(row, F.lit(h)), F.pmod(column, F.lit(w))


def quantised_planes(values: DataFrame, bits: int) -> DataFrame:
    """Values (sample_id, ..., value) as levels between the least and the largest of a sample; adds level, low, high."""
    group = Window.partitionBy("sample_id")
    out = values.withColumns({"low": F.min("value").over(group), "high": F.max("value").over(group)})
    span = F.col("high") - F.col("low")
    return out.withColumn("level", F.when(span > 0, F.rint((F.col("value") - F.col("low")) / span * (2**bits - 1))).otherwise(0.0).cast("int"))


def restored(level: Column, low: Column, high: Column, bits: int) -> Column:
    return level / (2**bits - 1) * (high - low) + low


def index_width(symbols: int) -> int:
    return max(1, (symbols - 1).bit_length())


def packed_indices(labels: Column, symbols: int) -> Column:
    """An array of labels below `symbols` as bytes of fixed-width codes, highest bit first, zeros at the end."""
    width = index_width(symbols)
    bits = F.array_join(F.transform(labels, lambda k: F.lpad(F.bin(k.cast("long")), width, "0")), "")
    size = F.ceil(F.size(labels) * width / 8).cast("int")
    whole = F.rpad(bits, size * 8, "0")
    octets = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.lpad(F.conv(F.substring(whole, k * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.when(size > 0, F.unhex(F.array_join(octets, ""))).otherwise(F.lit(b""))


def unpacked_indices(payload: Column, count: Column, symbols: int) -> Column:
    width = index_width(symbols)
    text = F.hex(payload)
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(payload) - 1), lambda k: F.lpad(F.conv(F.substring(text, k * 2 + 1, F.lit(2)), 16, 2), 8, "0"))
    bits = F.array_join(octets, "")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.conv(F.substring(bits, k * width + 1, F.lit(width)), 2, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def cost_report(costs: DataFrame, modules: int = 100, operators: int = 20) -> DataFrame:
    """(kind, name, flops, share): the costliest modules and operators of rows (module, operator, flops)."""
    total = costs.agg(F.sum("flops").alias("total"))

    def top(kind: str, n: int) -> DataFrame:
        return costs.groupBy(F.col(kind).alias("name")).agg(F.sum("flops").alias("flops")).orderBy(F.desc("flops"), "name").limit(n).select(F.lit(kind).alias("kind"), "name", "flops")

    both = top("module", modules).union(top("operator", operators))
    return both.crossJoin(F.broadcast(total)).select("kind", "name", "flops", (F.col("flops") / F.col("total")).alias("share"))


def mean_complexity(samples: DataFrame, names) -> DataFrame:
    """Means of stated costs over samples."""
    return samples.agg(F.count("*").alias("samples"), *[F.avg(n).alias(n) for n in names])
