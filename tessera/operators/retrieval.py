"""Nearest neighbours, retrieval quality, re-ranking, soft votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.neighbours import Blocks, regular
from tessera.operators.store import discard, materialize

#: Query values that one broadcast may hold; larger query sets are gone through in blocks.
BLOCK_VALUES = 20_000_000


def distances(queries: DataFrame, gallery: DataFrame, measure=V.squared_distance) -> DataFrame:
    """All columns of both sides and `dist`. Columns must differ; vectors are q_vec and g_vec.

    The stated queries are counted; each block of them that fits the bound is broadcast against the
    whole gallery, so the gallery isn't shuffled.
    """
    values = queries.agg(F.coalesce(F.sum(F.size("q_vec")), F.lit(0))).first()[0]
    blocks = max(1, -(-values // BLOCK_VALUES))
    out = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*[c for c in queries.columns if c != "q_vec"]), F.lit(blocks)) == k)
        pairs = gallery.crossJoin(F.broadcast(part)).withColumn("dist", measure(F.col("q_vec"), F.col("g_vec"))).drop("q_vec", "g_vec")
        out = pairs if out is None else out.union(pairs)
    return out


def top_k(pairs: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """The k nearest of each query with their rank, of equals the lowest g_id; Spark keeps k rows a task before it shuffles."""
    order = F.desc("dist") if descending else F.asc("dist")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(order, "g_id"))).where(F.col("rank") <= k)


def ranked(pairs: DataFrame) -> DataFrame:
    """Gallery rows of a query's own identity and camera removed, the rest ranked: adds rank, match, hits."""
    kept = pairs.where(~((F.col("q_pid") == F.col("g_pid")) & (F.col("q_cam") == F.col("g_cam"))))
    by = Window.partitionBy("q_id").orderBy("dist", "g_id")
    out = kept.withColumns({"rank": F.row_number().over(by), "match": (F.col("q_pid") == F.col("g_pid")).cast("int")})
    return out.withColumn("hits", F.sum("match").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def cmc_map(pairs: DataFrame, ranks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: valid queries, mAP and the share of queries with a hit by each rank. Queries without a match don't count."""
    each = ranked(pairs).where("match = 1").groupBy("q_id").agg(F.min("rank").alias("first"), F.avg(F.col("hits") / F.col("rank")).alias("ap"))
    return each.agg(F.count("*").alias("valid_queries"), F.avg("ap").alias("map"), *[F.avg((F.col("first") <= r).cast("double")).alias(f"cmc_{r}") for r in ranks])


def cmc_curve(pairs: DataFrame, max_rank: int = 50) -> DataFrame:
    """(rank, cmc) up to max_rank."""
    first = ranked(pairs).where("match = 1").groupBy("q_id").agg(F.min("rank").alias("first"))
    grid = first.select("q_id", "first", F.explode(F.sequence(F.lit(1), F.lit(max_rank))).alias("rank"))
    return grid.groupBy("rank").agg(F.avg((F.col("first") <= F.col("rank")).cast("double")).alias("cmc"))


def soft_vote(neighbours: DataFrame, ks: tuple[int, ...], temperature: float = 0.07) -> DataFrame:
    """(q_id, k, label, score) of rows (q_id, rank, sim, label): softmax over all neighbours, then sums of the first k."""
    group = Window.partitionBy("q_id")
    e = F.exp((F.col("sim") - F.max("sim").over(group)) / temperature)
    weighted = neighbours.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(group))
    each = weighted.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    return each.groupBy("q_id", "k", "label").agg(F.sum("p").alias("score"))


def predicted(votes: DataFrame) -> DataFrame:
    """The label of the largest score, rounded to 12 places, of equals the lowest."""
    by = Window.partitionBy("q_id", "k").orderBy(F.desc(F.round("score", 12)), "label")
    return votes.withColumn("place", F.row_number().over(by)).where("place = 1").drop("place")


def per_class_sample(rows: DataFrame, n: int, label: str, key: str) -> DataFrame:
    """The first n rows of each class, by key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("place") <= n).drop("place")


# K-reciprocal re-ranking


def neighbour_lists(dist: DataFrame, k: int) -> DataFrame:
    """(i, j, rank) of the k nearest j of each i, itself included, from all pairs (i, j, d); those without a distance come last."""
    return dist.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.asc_nulls_last("d"), F.asc_nulls_last("j")))).where(F.col("rank") <= k)


def reciprocal(dist: DataFrame, k: int) -> DataFrame:
    """(i, j): each among the other's first k + 1."""
    near = neighbour_lists(dist, k + 1).select("i", "j")
    return near.join(near.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"])


def scaled(dist: DataFrame) -> DataFrame:
    """Distances by column over their largest, transposed."""
    top = dist.groupBy("j").agg(F.max("d").alias("top"))
    return dist.join(top, "j").select(F.col("j").alias("i"), F.col("i").alias("j"), _over(F.col("d"), F.col("top")).alias("d"))


def _over(d: Column, top: Column) -> Column:
    """NaN over 0, where all vectors are equal."""
    return F.when(top == 0, float("nan")).otherwise(d / top)


def expanded(dist: DataFrame, k1: int) -> DataFrame:
    """(i, j): reciprocal neighbours, with those of a neighbour's half-sized list where over 2/3 of it are among them."""
    return joined_lists(reciprocal(dist, k1), reciprocal(dist, int(round(k1 / 2))))


def joined_lists(full: DataFrame, half: DataFrame) -> DataFrame:
    """expanded() of the reciprocal neighbours at full and at half size."""
    candidates = full.join(half.select(F.col("i").alias("j"), F.col("j").alias("c")), "j")
    marked = candidates.join(full.select("i", F.col("j").alias("c"), F.lit(1).alias("in_full")), ["i", "c"], "left")
    good = marked.groupBy("i", "j").agg((3 * F.count("in_full") > 2 * F.count("*")).alias("good")).where("good")
    return full.union(candidates.join(good, ["i", "j"]).select("i", F.col("c").alias("j"))).distinct()


def list_weights(rows: DataFrame, near: DataFrame, k2: int) -> DataFrame:
    """(i, j, w): the expanded lists (i, j, d) as weights, averaged over the first k2 of each i's own list."""
    rows = rows.withColumn("e", F.exp(-F.col("d")))
    sums = rows.groupBy("i").agg(F.sum("e").alias("total"))
    v = rows.join(sums, "i").select("i", "j", (F.col("e") / F.col("total")).alias("w"))
    if k2 != 1:
        first = neighbour_lists(near, k2).select("i", F.col("j").alias("n"))
        v = first.join(v.withColumnRenamed("i", "n"), "n").groupBy("i", "j").agg((F.sum("w") / k2).alias("w"))
    return v


def overlaps(v: DataFrame, queries: DataFrame) -> DataFrame:
    """(i, j, m): what the weights of query i and of any j have in common, where that is something."""
    left = v.join(queries, "i", "left_semi")
    return left.join(v.select(F.col("i").alias("k"), "j", F.col("w").alias("u")), "j").groupBy("i", F.col("k").alias("j")).agg(F.sum(F.least("w", "u")).alias("m"))


def rerank(dist: DataFrame, queries: DataFrame, k1: int = 50, k2: int = 15, weight: float = 0.3) -> DataFrame:
    """(i, j, dist) of each query i and gallery j, from all pairs (i, j, d) of both; `queries` holds the i.

    The expanded lists are sparse rows; their overlap is a join on the shared column, in double.
    """
    own = scaled(dist)
    shared = overlaps(list_weights(expanded(own, k1).join(own, ["i", "j"]), own, k2), queries)
    pairs = own.join(queries, "i", "left_semi").join(queries.select(F.col("i").alias("j")), "j", "left_anti")
    m = F.coalesce("m", F.lit(0.0))
    return pairs.join(shared, ["i", "j"], "left").select("i", "j", ((1 - m / (2 - m)) * (1 - weight) + F.col("d") * weight).alias("dist"))


def group_pairs(vectors: DataFrame) -> DataFrame:
    """(i, j, d) of all vectors (group, id, vec) of a group against each other: a row for each pair.

    As in the SQL, elements that either side lacks don't count, and where none are left there is no distance.
    """
    side = lambda v, p: vectors.select("group", F.col("id").alias(v), F.col("vec").alias(f"{p}_vec"))
    terms = F.zip_with("q_vec", "g_vec", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    d = F.aggregate(terms, F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x, s, x))
    return side("i", "q").join(side("j", "g"), "group").select("i", "j", d.alias("d"))


def reciprocal_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """reciprocal() of the vectors (group, id, vec, query) of each group; only neighbour lists become rows.

    What `regular` rules out (repeated ids, vectors with nulls or of several lengths) goes by all pairs.
    """
    if not regular(vectors):
        return reciprocal(scaled(group_pairs(vectors)), k)
    return reciprocal(materialize(Blocks(vectors).nearest(k + 1), "near"), k)


def rerank_vectors(vectors: DataFrame, k1: int = 50, k2: int = 15, weight: float = 0.3) -> DataFrame:
    """rerank() of the vectors (group, id, vec, query) of each group: of its queries and of its other vectors, the gallery.

    Rows are made of neighbour lists, of what these share, and of the result; what `regular` rules out goes by all pairs.
    """
    queries = vectors.where("query").select(F.col("id").alias("i"))
    if not regular(vectors):
        return rerank(group_pairs(vectors), queries.distinct(), k1, k2, weight)
    blocks = Blocks(vectors)
    near = materialize(blocks.nearest(max(k1 + 1, k2)), "near")
    tops = near.where("rank = 1").select("i", "top")
    side = lambda v: vectors.select(F.col("id").alias(v), F.col("vec").alias(f"{v}_vec"))
    full, half = materialize(reciprocal(near, k1), "full"), materialize(reciprocal(near, int(round(k1 / 2))), "half")
    both = materialize(joined_lists(full, half), "expanded")
    rows = both.join(side("i"), "i").join(side("j"), "j").join(tops, "i")
    rows = materialize(rows.select("i", "j", _over(V.squared_distance(F.col("i_vec"), F.col("j_vec")), F.col("top")).alias("d")), "lists")
    v = materialize(list_weights(rows, near, k2), "weights")
    shared = overlaps(v, queries).groupBy("i").agg(F.collect_list(F.struct("j", "m")).alias("near"))  # at most a row of the result for each
    dealt = materialize(vectors.where("query").select("group", F.col("id").alias("i"), "vec").join(tops, "i").join(shared, "i", "left"), "queries")
    discard(near, full, half, both, rows, v)
    return blocks.against_gallery(dealt, weight)


def multiview_groups(images: DataFrame, views: int = 3, key: str = "img_id", identity: str = "pid") -> DataFrame:
    """(pid, group, place, img_id): images of an identity by threes in order of id, the last filled up with its first image."""
    numbered = images.select(F.col(identity).alias("pid"), F.col(key).alias("img_id")).withColumn("n", F.row_number().over(Window.partitionBy("pid").orderBy("img_id")) - 1)
    whole = numbered.withColumns({"group": F.floor(F.col("n") / views).cast("int"), "place": F.pmod("n", F.lit(views)).cast("int")})
    filled = whole.groupBy("pid", "group").agg(F.sort_array(F.collect_list("img_id")).alias("ids"))  # at most `views` ids
    return filled.select("pid", "group", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(views - 1)), lambda k: F.coalesce(F.get("ids", k), F.get("ids", F.lit(0))))).alias("place", "img_id"))


def round_robin(groups: DataFrame) -> DataFrame:
    """Groups in turn over identities: adds the round and sorts."""
    return groups.orderBy("group", "pid", "place")


def vehicle_groups_are_pure(images: DataFrame, views: int = 3) -> Column:
    """Whether every `views` neighbouring query rows are one identity: one row with the verdict and the starts."""
    blocks = images.withColumn("block", F.floor(F.col("img_idx") / views)).groupBy("block").agg(F.count_distinct("pid").alias("pids"), F.min("img_idx").alias("start"))
    return blocks.agg(F.max("pids").alias("most"), F.sort_array(F.collect_list("start")).alias("starts"))


def random_per_class(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """`n` rows of each class, drawn by a hash of seed and key: the same draw on any cluster, another one for another seed."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    ranked = rows.withColumn("drawn", F.row_number().over(Window.partitionBy(label).orderBy(draw, key)))
    return ranked.where(F.col("drawn") <= n)  # each task keeps its own first n before the shuffle
