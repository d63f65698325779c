"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, splittable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges; the root is the smallest node of its component.

    Nodes are integers. Each step takes the smallest neighbour of a node, a minimum by key that is combined
    before the shuffle, and joins it back; edges only ever shrink to stars, whose tables are written to the
    shared folder.
    """
    live = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(splittable(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(splittable(small, "u"), "u")
        after = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, live = live, materialize(after, "edges")
        discard(before)
        now = live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(live.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
