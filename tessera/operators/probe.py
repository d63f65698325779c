"""Linear probes on frozen features, by Spark's own logistic regression."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logistic_probe(train: DataFrame, test: DataFrame, strengths: tuple[float, ...] = (0.0, 0.01, 0.1), rounds: int = 30) -> DataFrame:
    """(strength, accuracy) on the test rows (vec, label) of models fitted to the training rows."""
    vectors = lambda df: df.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    left, right = vectors(train), vectors(test)
    out = None
    for s in strengths:
        model = LogisticRegression(regParam=s, maxIter=rounds).fit(left)
        row = model.transform(right).agg(F.lit(s).alias("strength"), (100 * F.avg((F.col("prediction") == F.col("label")).cast("double"))).alias("accuracy"))
        out = row if out is None else out.union(row)
    return out


def averaged_tries(samples, evaluate, tries: int) -> DataFrame:
    """Mean accuracy by `k` over tries; `evaluate(rows)` gives (k, accuracy) for one drawn sample."""
    out = None
    for t in range(tries):
        rows = evaluate(samples(t)).withColumn("trial", F.lit(t))
        out = rows if out is None else out.union(rows)
    return out.groupBy("k").agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("tries"))
