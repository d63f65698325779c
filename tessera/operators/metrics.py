"""Task quality as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def top_k_accuracy(k: int, ranking: Column, target: Column) -> Column:
    """Percent of rows whose target is among the first k; 0 without rows."""
    return F.coalesce(100 * F.avg(F.array_contains(F.slice(ranking, 1, k), target).cast("double")), F.lit(0.0))


def class_accuracy(rows: DataFrame, pred: str, gt: str) -> DataFrame:
    """(class, n, accuracy), percent."""
    return rows.groupBy(F.col(gt).alias("class")).agg(F.count("*").alias("n"), (100 * F.avg((F.col(pred) == F.col(gt)).cast("double"))).alias("accuracy"))


def multilabel_accuracy(predicted: Column, targets: Column) -> Column:
    """Any hit counts; rows without a defined target don't."""
    defined = F.filter(targets, lambda t: t >= 0)
    return 100 * F.avg(F.when(F.size(defined) > 0, F.array_contains(defined, predicted).cast("double")))


def confusion(rows: DataFrame, pred: str, gt: str, classes: int) -> DataFrame:
    """(gt, pred, n), dense; rows with gt outside of [0, classes) don't count."""
    spark = rows.sparkSession
    found = rows.where((F.col(gt) >= 0) & (F.col(gt) < classes)).groupBy(F.col(gt).cast("int").alias("gt"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    grid = spark.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("gt"), F.pmod("id", F.lit(classes)).cast("int").alias("pred"))
    return grid.join(found, ["gt", "pred"], "left").select("gt", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_iou(matrix: DataFrame) -> DataFrame:
    """(class, tp, gt_n, pred_n, iou) of a confusion table; iou is null for an empty union."""
    cells = matrix.select(F.explode(F.array(F.struct(F.col("gt").alias("class"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("gt_n"), F.lit(0).cast("long").alias("pred_n")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("gt_n"), F.col("n").alias("pred_n")))).alias("c")).select("c.*")
    sums = cells.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("gt_n").alias("gt_n"), F.sum("pred_n").alias("pred_n"))
    union = F.col("gt_n") + F.col("pred_n") - F.col("tp")
    return sums.withColumn("iou", F.when(union > 0, F.col("tp") / union))


def parts_iou(rows: DataFrame, pred: str, gt: str, parts: int = 6, ignore: int = 255) -> DataFrame:
    """Mean IoU in percent over the background and `parts` parts; an absent part counts as 0, pixels of `ignore` don't count."""
    each = []
    for k in range(parts + 1):
        p, g = F.col(pred) == k, F.col(gt) == k
        union = F.sum((p | g).cast("int"))
        each.append(F.coalesce(F.sum((p & g).cast("int")), F.lit(0)) / F.greatest(F.coalesce(union, F.lit(0)).cast("double"), F.lit(1e-8)))
    total = each[0]
    for one in each[1:]:
        total = total + one
    return rows.where(F.col(gt) != ignore).agg((100 * total / (parts + 1)).alias("miou"))


#: Which metrics a task has.
TASK_METRICS = {
    "semseg": ("miou",), "human_parts": ("miou",), "sal": ("maxf", "miou"), "edge": ("loss",), "normals": ("mean_angle",), "depth": ("rmse", "abs_rel"), "cls": ("top1", "top5"),
}


def metrics_of(task: str) -> tuple[str, ...]:
    if task not in TASK_METRICS:
        raise ValueError(f"no metric for task {task!r}")
    return TASK_METRICS[task]


def mean_iou(matrix: DataFrame) -> DataFrame:
    """A fraction; classes with an empty union are left out."""
    return class_iou(matrix).agg(F.avg("iou").alias("miou"))


def mean_iou_percent(matrix: DataFrame) -> DataFrame:
    """Percent; classes with an empty union count as 0."""
    return class_iou(matrix).agg((100 * F.avg(F.coalesce("iou", F.lit(0.0)))).alias("miou"))


def jaccard(pred: Column, gt: Column) -> dict[str, Column]:
    """Sums of a binary comparison and the index; empty against empty is 1."""
    tp, fp, fn = (F.sum(x.cast("long")) for x in (pred & gt, pred & ~gt, ~pred & gt))
    return {"tp": tp, "fp": fp, "fn": fn, "jaccard": F.when(tp + fp + fn == 0, 1.0).otherwise(tp / (tp + fp + fn)), "precision": tp / (tp + fp + 1e-12), "recall": tp / (tp + fn + 1e-12)}


def saliency_max_f(rows: DataFrame, pred: str, target: str, step: float = 0.05, beta_squared: float = 0.3, ignore: int = 255) -> DataFrame:
    """100 * the best F over thresholds of sigmoid(pred / 255); 0/0 counts as 0."""
    thresholds = [step * k for k in range(1, math.ceil(round(1 / step, 9)))]
    p = V.sigmoid(F.col(pred) / 255.0)
    t = F.col(target).cast("int")
    sums = rows.where(F.col(target) != ignore).agg(*[x for k, th in enumerate(thresholds) for x in (F.sum(F.when(p >= th, t).otherwise(0)).alias(f"tp{k}"), F.sum((p >= th).cast("int")).alias(f"pp{k}"))], F.sum(t).alias("ap"))

    def score(k: int) -> Column:
        precision, recall = F.try_divide(F.col(f"tp{k}"), F.col(f"pp{k}")), F.try_divide(F.col(f"tp{k}"), F.col("ap"))
        return F.coalesce(F.try_divide((1 + beta_squared) * precision * recall, beta_squared * precision + recall), F.lit(0.0))

    return sums.select((100 * F.greatest(*[score(k) for k in range(len(thresholds))])).alias("max_f"))


def balanced_edge_loss(logit: Column, target: Column, positive_weight: float = 0.95) -> Column:
    """Mean weighted cross-entropy with logits; a stable form of log(1 + e^-x)."""
    soft = F.greatest(-logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))
    return F.avg(positive_weight * target * soft + (1 - positive_weight) * (1 - target) * (soft + logit))


def normal_angle(pred: Column, gt: Column) -> Column:
    """Degrees between two vectors made unit length; a zero vector stays zero."""
    unit = lambda v: F.transform(v, lambda x: F.when(V.norm(v) == 0, 0.0).otherwise(x.cast("double") / V.norm(v)))
    a, b = unit(pred), unit(gt)
    less = V.norm(F.zip_with(a, b, lambda x, y: x - y))
    more = V.norm(F.zip_with(a, b, lambda x, y: x + y))
    return F.degrees(2 * F.atan2(less, more))


def depth_pooled(rows: DataFrame, pred: str, gt: str, low: float | None = None, high: float | None = None, ignore: float | None = None) -> DataFrame:
    """rmse, log_rmse, abs_rel, sq_rel over all pixels within strict bounds, or but the ignored; 0 without any."""
    good = F.lit(True)
    if low is not None:
        good &= F.col(gt) > low
    if high is not None:
        good &= F.col(gt) < high
    if ignore is not None:
        good &= F.col(gt) != ignore
    lift = lambda c: F.when(F.col(c) <= 0, 1e-9).otherwise(F.col(c))
    kept = rows.where(good).select(lift(pred).alias("p"), lift(gt).alias("g"))
    e, z = F.col("g") - F.col("p"), F.lit(0.0)
    log = F.log("g") - F.log("p")
    return kept.agg(
        F.count("*").alias("n"), F.coalesce(F.sqrt(F.avg(e * e)), z).alias("rmse"), F.coalesce(F.sqrt(F.avg(log * log)), z).alias("log_rmse"),
        F.coalesce(F.avg(F.abs(e) / F.col("g")), z).alias("abs_rel"), F.coalesce(F.avg(e * e / F.col("g")), z).alias("sq_rel"),
    )


DEPTH_NAMES = ("a1", "a2", "a3", "abs_rel", "rmse", "log_10", "rmse_log", "silog", "sq_rel", "mae")


def depth_per_image(rows: DataFrame, image: str, pred: str, gt: str, low: float, high: float, scale: float = 1000.0) -> DataFrame:
    """Ten errors of each image: gt over `scale`, pred clipped to the range, gt at or beyond it left out."""
    g, p = F.col(gt) / scale, F.greatest(F.lit(low), F.least(F.lit(high), F.col(pred)))
    kept = rows.select(image, g.alias("g"), p.alias("p")).where((F.col("g") > low) & (F.col("g") < high))
    ratio, e = F.greatest(F.col("g") / F.col("p"), F.col("p") / F.col("g")), F.col("g") - F.col("p")
    log = F.log("g") - F.log("p")
    within = lambda k: F.avg((ratio < 1.25**k).cast("double"))
    return kept.groupBy(image).agg(
        within(1).alias("a1"), within(2).alias("a2"), within(3).alias("a3"), F.avg(F.abs(e) / F.col("g")).alias("abs_rel"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(F.log10("g") - F.log10("p"))).alias("log_10"), F.sqrt(F.avg(log * log)).alias("rmse_log"), (100 * F.sqrt(F.greatest(F.avg(log * log) - F.avg(log) * F.avg(log), F.lit(0.0)))).alias("silog"),
        F.avg(e * e / F.col("g")).alias("sq_rel"), F.avg(F.abs(e)).alias("mae"),
    )


def mean_over_images(per_image: DataFrame, names=DEPTH_NAMES) -> DataFrame:
    return per_image.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])


#: The evaluation crop (top, bottom, left, right) of images of 480 x 640.
EIGEN_CROP, EIGEN_SIZE = (45, 471, 41, 601), (480, 640)


def eigen_crop(y: Column, x: Column, h: Column, w: Column) -> Column:
    """Whether a pixel is in the evaluation crop, scaled to h x w."""
    at = lambda v, size, full: F.floor(F.lit(v / full) * size)
    (top, bottom, left, right), (rows, columns) = EIGEN_CROP, EIGEN_SIZE
    return (y >= at(top, h, rows)) & (y < at(bottom, h, rows)) & (x >= at(left, w, columns)) & (x < at(right, w, columns))


def psnr(mse: Column, floor: float = 1e-10) -> Column:
    return -10 * F.log10(F.greatest(mse, F.lit(floor)))


def yuv_combined(y: Column, u: Column, v: Column) -> Column:
    return (6 * y + u + v) / 8


def ms_ssim_db(x: Column) -> Column:
    """Infinite at 1 and NaN beyond it, as IEEE logarithms are; Spark's log10 is null there, which means would pass over."""
    left = 1 - x
    return -10 * F.when(left < 0, float("nan")).when(left == 0, float("-inf")).otherwise(F.log10(left))


def two_level_mean(frames: DataFrame, sequence: str, names) -> DataFrame:
    """Means over each sequence, then over sequences, to 6 places."""
    each = frames.groupBy(sequence).agg(*[F.avg(n).alias(n) for n in names])
    return each.agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


def record_mean(rows: DataFrame, names, strict: bool = False) -> DataFrame:
    """Sums over the number of all rows; `strict` refuses a row that lacks a value."""
    value = lambda n: F.coalesce(F.col(n), F.raise_error(F.lit(f"{n} is missing")).cast("double")) if strict else F.col(n)
    return rows.agg(*[(F.sum(value(n)) / F.count("*")).alias(n) for n in names])


def cross_entropy(log_probability: Column, weight: Column | None = None) -> Column:
    """Mean loss of valid rows, weighted by class where weights are given."""
    return -F.avg(log_probability) if weight is None else -F.sum(log_probability * weight) / F.sum(weight)


def scale_invariant_log(pred: Column, gt: Column, weight: float = 0.5) -> Column:
    """sqrt(mean(d^2) - weight * mean(d)^2) of log differences."""
    d = F.log(pred) - F.log(gt)
    return F.sqrt(F.greatest(F.avg(d * d) - weight * F.avg(d) * F.avg(d), F.lit(0.0)))


def masked_l1(pred: Column, gt: Column, valid: Column) -> Column:
    """Mean absolute difference of valid rows; 0 without any."""
    return F.coalesce(F.avg(F.when(valid, F.abs(pred - gt))), F.lit(0.0))


def per_metric_mean(rows: DataFrame, names) -> DataFrame:
    """Mean of each metric over the samples that have it, and how many have."""
    return rows.agg(*[x for n in names for x in (F.avg(n).alias(n), F.count(n).alias(f"{n}_count"))])


def balanced_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """(label, weight): inverse frequencies, with a mean weight of 1 over rows; absent classes have 0."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"), F.count_distinct(label).alias("seen"))
    grid = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    return grid.join(counts, "label", "left").crossJoin(F.broadcast(total)).select("label", F.coalesce(F.col("total") / (F.col("seen") * F.col("n")), F.lit(0.0)).alias("weight"))
