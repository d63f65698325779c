"""Sequential coding state as windows over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The offset of the quantiser by place in a group of eight frames.
QP_OFFSETS = (0, 1, 0, 2, 0, 2, 0, 2)


def is_intra(frame: Column, period: int) -> Column:
    return (frame == 0) | (F.lit(period > 0) & (F.pmod(frame, F.lit(max(period, 1))) == 0))


def schedule(frames: DataFrame, period: int, reset_interval: int, qp: int, sequence: str = "sequence") -> DataFrame:
    """Adds kind (I or P), qp, reset, and the qp that the frame before left behind (none after an intra reset)."""
    idx = F.col("frame_idx")
    intra = is_intra(idx, period)
    offset = F.element_at(F.array(*map(F.lit, QP_OFFSETS)), F.pmod(idx, F.lit(8)).cast("int") + 1)
    reset = ~intra & F.lit(reset_interval > 0) & (F.pmod(idx, F.lit(max(reset_interval, 1))) == 1)
    out = frames.withColumns({"kind": F.when(intra, "I").otherwise("P"), "qp": F.when(intra, qp).otherwise(qp + offset), "reset": reset})
    return out.withColumn("last_qp", F.when(F.col("kind") == "P", F.lag("qp").over(Window.partitionBy(sequence).orderBy("frame_idx"))))


def parameter_sets(frames: DataFrame, keys, sequence: str = "sequence") -> DataFrame:
    """Adds sps_id, numbered by first use, and whether the frame is that first use."""
    first = frames.groupBy(sequence, *keys).agg(F.min("frame_idx").alias("first_use"))
    numbered = first.withColumn("sps_id", F.dense_rank().over(Window.partitionBy(sequence).orderBy("first_use")) - 1)
    return frames.join(numbered, [sequence, *keys]).withColumn("writes_sps", F.col("frame_idx") == F.col("first_use"))


def two_coders(h: Column, w: Column) -> Column:
    return h * w > 1280 * 720


def picture_bytes(payload: Column, writes_sps: Column, sps_bytes: int = 0) -> Column:
    """Header byte, qp byte, length code and payload of a picture, with its parameter set if it is new."""
    from tessera.functions.codes import varint_size

    size = F.octet_length(payload)
    return 2 + varint_size(size) + size + F.when(writes_sps, sps_bytes).otherwise(0)
