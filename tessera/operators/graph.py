"""Propagation on affinity graphs and choice of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.store import materialize

FLOOR = 1e-8


def transition(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, w): heads averaged, made symmetric, rows made to sum to 1."""
    heads = edges.groupBy("graph_id", "src", "dst").agg(F.avg("w").alias("w"))
    both = heads.select("graph_id", "src", "dst", (F.col("w") / 2).alias("w")).union(heads.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / 2).alias("w")))
    summed = both.groupBy("graph_id", "src", "dst").agg(F.sum("w").alias("w"))
    rows = summed.groupBy("graph_id", "src").agg(F.sum("w").alias("total"))
    return summed.join(rows, ["graph_id", "src"]).select("graph_id", "src", "dst", (F.col("w") / F.greatest("total", F.lit(FLOOR))).alias("w"))


def propagate(edges: DataFrame, seed: int = 0, beta: float = 0.1, rounds: int = 10, eps: float | None = 1e-3, cut_every: int = 4) -> DataFrame:
    """(graph_id, node, score) after s <- beta * seed + (1 - beta) * A's, from the seed.

    With `eps`, stops when every graph's scores moved by less in sum. The transitions are written to the shared
    folder once, scores every few rounds, which cuts the lineage and survives lost executors.
    """
    if rounds < 1 or not 0.0 < beta <= 1.0 or (eps is not None and eps <= 0.0):
        raise ValueError("rounds and eps must be positive, beta in (0, 1]")
    steps = materialize(transition(edges), "transitions")
    nodes = steps.select("graph_id", F.col("src").alias("node")).union(steps.select("graph_id", F.col("dst").alias("node"))).distinct()
    at_seed = (F.col("node") == seed).cast("double")
    scores = nodes.withColumn("score", at_seed)
    for k in range(rounds):
        flow = steps.join(scores.withColumnRenamed("node", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("score")).alias("flow"))
        after = nodes.join(flow, ["graph_id", "node"], "left").select("graph_id", "node", (beta * at_seed + (1 - beta) * F.coalesce("flow", F.lit(0.0))).alias("score"))
        if eps is not None:
            after = materialize(after, "scores")
            moved = after.join(scores.withColumnRenamed("score", "before"), ["graph_id", "node"]).groupBy("graph_id").agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("d")).agg(F.max("d")).first()[0]
            scores = after
            if moved is None or moved < eps:
                break
        else:
            scores = materialize(after, "scores") if k % cut_every == cut_every - 1 else after
    return scores


def kept_count(tokens: Column, ratio: float) -> Column:
    """max(int((tokens - 1) * ratio), 1) patches of a sample of tokens, the class token apart."""
    return F.greatest(F.floor((tokens - 1) * F.lit(float(ratio))).cast("int"), F.lit(1))


def top_tokens(scores: DataFrame, ratio: float) -> DataFrame:
    """(graph_id, node): the class token 0 and the best patches, in order of node; all, where all are kept."""
    if not 0.0 < ratio <= 1.0:
        raise ValueError("the ratio must be in (0, 1]")
    group = Window.partitionBy("graph_id")
    ranked = scores.withColumn("n", F.count("*").over(group)).withColumn("place", F.row_number().over(group.orderBy(F.col("node") == 0, F.desc("score"), "node")))
    return ranked.where((F.col("node") == 0) | (F.col("place") <= kept_count(F.col("n"), ratio))).select("graph_id", "node")


def checked_tokens(tokens: DataFrame) -> DataFrame:
    """(graph_id, node, original): tokens as they are, an error for a graph without a patch, a negative or a repeated original place.

    Node 0 is the class token, whose original place isn't looked at.
    """
    patch = F.col("node") > 0
    sums = tokens.groupBy("graph_id").agg(
        F.sum(patch.cast("int")).alias("patches"), F.min(F.when(patch, F.col("original"))).alias("low"), F.count_distinct(F.when(patch, F.col("original"))).alias("places")
    )
    bad = F.when(F.col("patches") < 1, "a graph needs a patch").when(F.col("low") < 0, "original places must not be negative").when(F.col("places") < F.col("patches"), "original places must not repeat")
    good = sums.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).select("graph_id")
    return tokens.join(good, "graph_id", "left_semi")


def multiview_index(view: Column, patch: Column, patches: int) -> Column:
    return view * patches + patch


def view_of(index: Column, patches: int) -> Column:
    return F.floor(index / patches).cast("int")
