"""Streaming forms: frames with carried state, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.video import QP_OFFSETS

FRAMES = "sequence long, frame_idx long, kind string, qp int, last_qp int, sps_id int, writes_sps boolean"
STATE = "last_qp int, shapes array<string>"


def coded(frames: DataFrame, period: int, qp: int) -> DataFrame:
    """Frames (sequence, frame_idx, shape) as they come, in order within a sequence, with the carried quantiser
    and the parameter sets used so far; state is one small row for each sequence. Equals the batch form."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, known = state.get if state.exists else (None, [])
        known, out = list(known), []
        for r in pd.concat(list(batches)).sort_values("frame_idx").itertuples():
            intra = r.frame_idx == 0 or period > 0 and r.frame_idx % period == 0
            now = qp if intra else qp + QP_OFFSETS[r.frame_idx % 8]
            new = r.shape not in known
            if new:
                known.append(r.shape)
            out.append((key[0], r.frame_idx, "I" if intra else "P", now, None if intra else last, known.index(r.shape), new))
            last = now
        state.update((last, known))
        frame = pd.DataFrame(out, columns=["sequence", "frame_idx", "kind", "qp", "last_qp", "sps_id", "writes_sps"])
        yield frame.astype({"last_qp": "Int32"})

    return frames.groupBy("sequence").applyInPandasWithState(step, FRAMES, STATE, "append", GroupStateTimeout.NoTimeout)


def event_time(events: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with a watermark; a time without zone is taken as UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed(events: DataFrame, length: str, slide: str | None = None, column: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; batch and stream alike."""
    window = F.window(column, length, slide) if slide else F.window(column, length)
    return events.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, column: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, n) of sessions with at most `gap` between events."""
    return events.groupBy(F.session_window(column, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
