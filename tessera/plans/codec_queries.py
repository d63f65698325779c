"""Queries of codecs behind the model boundary and of image quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import image_quality
from tessera.plans import plan
from tessera.plans.registry import query, sql_distance, table

# Codecs

GROUPS, WORDS, DIMS = 8, 16, 64
WIDTH = DIMS // GROUPS
PART = f"{{}}[g * {WIDTH} + 1 : g * {WIDTH} + {WIDTH}]"
SCALED = "list_transform(v, lambda x: (x - mu) / sd)"


@query(
    f"""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_avg(embedding::DOUBLE[]) AS mu FROM embeddings),
    b AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) / {DIMS} + 1e-5::DOUBLE) AS sd FROM a),
    z AS (SELECT vec_id, mu::FLOAT::DOUBLE AS mu, sd::FLOAT::DOUBLE AS sd, list_reverse(v) AS v, list_reverse({SCALED}) AS z FROM b),
    words AS (SELECT g, k, list_transform(range({WIDTH}), lambda i: ((k * 7 + g * 3 + i * 5) % 11 - 5) / 3.0::DOUBLE) AS w FROM range({GROUPS}) x(g), range({WORDS}) y(k)),
    best AS (SELECT vec_id, g, any_value(mu) AS mu, any_value(sd) AS sd, any_value({PART.format("v")}) AS v, arg_min(w, {sql_distance(PART.format("z"), "w")}) AS w FROM z, words GROUP BY 1, 2)
    SELECT vec_id, round(sum({sql_distance("list_transform(w, lambda x: x * sd + mu)", "v")}) / {DIMS}, 6) AS mse, 96::BIGINT AS side_bits, {GROUPS}::BIGINT AS label_streams FROM best GROUP BY 1"""
)
def product_codec(spark, sf_dir):
    """Vectors through normalisation, a rotation, codebooks, range coding and back: error, and bits of side information."""
    g, k, i = np.ogrid[:GROUPS, :WORDS, :WIDTH]
    words = ((k * 7 + g * 3 + i * 5) % 11 - 5) / 3
    codec = plan.build({"type": "product", "rotation": np.eye(DIMS)[::-1], "codebooks": words, "pmf": np.full((GROUPS, WORDS), 1 / WORDS)})
    samples = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.array("embedding").alias("vec"))

    def meter(rows):
        pairs = F.arrays_zip(F.col("vec")[0].alias("x"), F.col("pred_vec")[0].alias("y"))
        squares = F.transform(pairs, lambda s: (s["x"] - s["y"]) * (s["x"] - s["y"]))
        return rows.select("sample_id", F.round(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / DIMS, 6).alias("mse"))

    bits, errors = plan.evaluate(samples, codec, meter)
    by_sample = bits.groupBy("sample_id").agg(F.sum(F.when(F.col("stream") == "side", F.col("bits"))).alias("side_bits"), F.sum((F.col("stream") != "side").cast("long")).alias("label_streams"))
    return errors.join(by_sample, "sample_id").withColumnRenamed("sample_id", "vec_id")


POINTS = (-0.2, -0.05, 0.0, 0.05, 0.1, 0.3)


@query(
    f"""SELECT vec_id, CAST(round(20 * list_sum(list_transform(embedding, lambda x: list_extract({list(POINTS)}::DOUBLE[], greatest(1, len(list_filter({list(POINTS)}::DOUBLE[], lambda p: p <= x::DOUBLE))))))) AS BIGINT) AS total,
    {8 * DIMS}::BIGINT AS bits FROM embeddings"""
)
def nonlinear_codec(spark, sf_dir):
    """Vectors as numbers of quantisation points and back; sums in steps of the points."""
    samples = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("vec"))
    bits, sums = plan.evaluate(samples, plan.build({"type": "nonlinear", "points": POINTS}), lambda rows: rows.select("sample_id", F.round(20 * F.aggregate("pred_vec", F.lit(0.0), lambda a, x: a + x)).cast("long").alias("total")))
    return sums.join(bits.select("sample_id", F.col("bits").cast("long").alias("bits")), "sample_id").withColumnRenamed("sample_id", "vec_id")


# Image quality

SIDE = 8  # vectors as images of 8 x 8


@query(
    f"""WITH cells AS (SELECT vec_id, i, (i // {SIDE}) // 2 AS y, (i % {SIDE}) // 2 AS x, embedding[i + 1]::DOUBLE * 255 AS a, round(embedding[i + 1]::DOUBLE, 1) * 255 AS b FROM embeddings, range({DIMS}) r(i)),
    half AS (SELECT vec_id, y, x, avg(a) AS a, avg(b) AS b FROM cells GROUP BY 1, 2, 3),
    grown AS (SELECT c.vec_id, c.y, c.x, sum(n.a * (n.x - c.x)) / 3 AS ax, sum(n.a * (n.y - c.y)) / 3 AS ay, sum(n.b * (n.x - c.x)) / 3 AS bx, sum(n.b * (n.y - c.y)) / 3 AS by_
        FROM half c JOIN half n ON c.vec_id = n.vec_id AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY 1, 2, 3),
    m AS (SELECT vec_id, sqrt(ax * ax + ay * ay) AS g, sqrt(bx * bx + by_ * by_) AS h FROM grown)
    SELECT vec_id, round(stddev_samp((2 * g * h + 170) / (g * g + h * h + 170)), 6) AS gmsd FROM m GROUP BY 1"""
)
def gradient_deviation(spark, sf_dir):
    """Gradient magnitude similarity deviation of vectors, as images, and their values rounded to one place."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    rows = rows.withColumn("b", F.transform("a", lambda x: F.round(x, 1)))
    return rows.select("vec_id", F.round(image_quality.gmsd("a", "b", F.lit(SIDE), F.lit(SIDE)), 6).alias("gmsd"))


@query(
    """SELECT n_nationkey, round(pow((2 * a * b + 0.0001::DOUBLE) / (a * a + b * b + 0.0001::DOUBLE), 0.1333::DOUBLE), 6) AS ms_ssim
    FROM (SELECT n_nationkey, (n_nationkey + 1) / 32.0::DOUBLE AS a, (n_regionkey + 1) / 8.0::DOUBLE AS b FROM nation)"""
)
def plain_ms_ssim(spark, sf_dir):
    """Multi-scale similarity of evenly grey images: the luminance term of the last scale."""
    side, grey = 176, lambda c, n: F.array_repeat((F.col(c) + 1) / n, 176 * 176)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", grey("n_nationkey", 32.0).alias("a"), grey("n_regionkey", 8.0).alias("b"))
    return rows.select("n_nationkey", F.round(image_quality.ms_ssim("a", "b", F.lit(side), F.lit(side)), 6).alias("ms_ssim"))
