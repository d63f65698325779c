"""Boxes: overlap and average precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Overlap of two arrays [x1, y1, x2, y2]; the denominator has 1e-6 more."""
    span = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    inter = span(0, 2) * span(1, 3)
    return inter / (area(a) + area(b) - inter + 1e-6)


def average_precision(pred: list[tuple[float, list[float]]], gt: list[list[float]], threshold: float) -> float:
    """Step integral over predictions by falling score. A prediction goes to its best box, taken or not."""
    if not pred:
        return 0.0
    order = sorted(range(len(pred)), key=lambda i: -pred[i][0])
    taken, hits, area, last = set(), 0, 0.0, 0.0
    boxes = np.asarray(gt, float).reshape(-1, 4)
    for n, i in enumerate(order, 1):
        p = np.asarray(pred[i][1], float)
        if len(boxes):
            wide = np.clip(np.minimum(p[2:], boxes[:, 2:]) - np.maximum(p[:2], boxes[:, :2]), 0, None)
            inter = wide[:, 0] * wide[:, 1]
            share = inter / ((p[2] - p[0]) * (p[3] - p[1]) + (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) - inter + 1e-6)
            best = int(share.argmax())
            if share[best] > 0 and share[best] >= threshold and best not in taken:
                taken.add(best)
                hits += 1
        recall = hits / (len(gt) + 1e-6)
        area += hits / (n + 1e-6) * (recall - last)
        last = recall
    return area


def class_average_precision(pred: DataFrame, gt: DataFrame, thresholds: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(image, cls, threshold, ap, has_gt): rows (image, cls, score, box) against (image, cls, box); class 0 is background.

    The greedy match is sequential within an image and class, so those boxes meet in one row; rows of many
    images go through Python in one Arrow batch.
    """
    left = pred.where("cls <> 0").groupBy("image", "cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "box"))).alias("found"))
    right = gt.where("cls <> 0").groupBy("image", "cls").agg(F.sort_array(F.collect_list("box")).alias("boxes"))
    rows = left.join(right, ["image", "cls"], "full").select("image", "cls", F.col("found.s").alias("scores"), F.col("found.box").alias("found"), "boxes")

    def run(batches):
        for batch in batches:
            out = []
            for image, cls, scores, found, boxes in zip(*(c.to_pylist() for c in batch.columns)):
                predictions = [(-s, b) for s, b in zip(scores or [], found or [])]
                out += [(image, cls, t, average_precision(predictions, boxes or [], t), bool(boxes)) for t in thresholds]
            kinds = (batch.column(0).type, batch.column(1).type, pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["image", "cls", "threshold", "ap", "has_gt"])

    return rows.mapInArrow(run, "image long, cls int, threshold double, ap double, has_gt boolean")


def mean_average_precision(found: DataFrame) -> DataFrame:
    """(image, threshold, map): the mean over classes that have a box; 0 where none has."""
    return found.groupBy("image", "threshold").agg(F.coalesce(F.avg(F.when(F.col("has_gt"), F.col("ap"))), F.lit(0.0)).alias("map"))


def coco_summary(found: DataFrame) -> DataFrame:
    """(image, map_50, map_75, map_50_95) of ten thresholds."""
    each = mean_average_precision(found)
    at = lambda t: F.max(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("map")))
    return each.groupBy("image").agg(at(0.5).alias("map_50"), at(0.75).alias("map_75"), F.avg("map").alias("map_50_95"))


def frame_statistics(frames, value: str = "map") -> DataFrame:
    """Mean, population deviation, extremes and median over frames, of a table or of its groups; a missing frame counts as 0 before this."""
    v = F.col(value)
    return frames.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), F.median(v).alias("median"), F.count("*").alias("frames"))


def step_integral(points: DataFrame, group: str, order: str, x: str, y: str) -> DataFrame:
    """(group, area): the sum over points in order of the step in x, from 0 at first, times y."""
    before = F.coalesce(F.lag(x).over(Window.partitionBy(group).orderBy(order)), F.lit(0.0))
    return points.withColumn("step", F.col(x) - before).groupBy(group).agg(F.sum(F.col("step") * F.col(y)).alias("area"))
