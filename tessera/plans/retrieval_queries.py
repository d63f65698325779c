"""Queries of retrieval, nearest neighbours and their quality. Queries are the vectors whose id divides by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import graph, metrics, retrieval, video
from tessera.plans.registry import query, sql_distance, sql_dot, table
from tessera.sources import files


def _sides(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    side = lambda p: [F.col("vec_id").alias(f"{p}_id"), F.col("label").alias(f"{p}_pid"), F.pmod("vec_id", F.lit(4)).alias(f"{p}_cam"), F.col("embedding").alias(f"{p}_vec")]
    return rows.where("vec_id % 50 = 0").select(*side("q")), rows.where("vec_id % 50 <> 0").select(*side("g"))


def _pairs(spark, sf_dir):
    return retrieval.distances(*_sides(spark, sf_dir))


PAIRS = f"""pairs AS (SELECT q.vec_id AS q_id, g.vec_id AS g_id, q.label AS q_pid, g.label AS g_pid, q.vec_id % 4 AS q_cam, g.vec_id % 4 AS g_cam,
    {sql_distance("q.embedding", "g.embedding")} AS dist FROM embeddings q, embeddings g WHERE q.vec_id % 50 = 0 AND g.vec_id % 50 <> 0)"""
RANKED = f"""{PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, g_id) AS rank, (q_pid = g_pid)::INTEGER AS match FROM pairs WHERE NOT (q_pid = g_pid AND q_cam = g_cam)),
    hits AS (SELECT *, sum(match) OVER (PARTITION BY q_id ORDER BY rank) AS hits FROM ranked),
    each AS (SELECT q_id, min(rank) AS first, avg(hits::DOUBLE / rank) AS ap FROM hits WHERE match = 1 GROUP BY q_id)"""


@query(f"WITH {PAIRS} SELECT q_id, g_id, CAST(rank AS INTEGER) AS rank, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, g_id) AS rank FROM pairs) WHERE rank <= 10")
def retrieval_topk(spark, sf_dir):
    return retrieval.top_k(_pairs(spark, sf_dir), 10).select("q_id", "g_id", "rank", F.round("dist", 9).alias("dist"))


PAIRS_ALL = f"""pairs AS (SELECT q.vec_id AS q_id, g.vec_id AS g_id, {sql_distance("q.embedding", "g.embedding")} AS dist FROM embeddings q, embeddings g WHERE q.vec_id % 50 = 0 AND q.vec_id <> g.vec_id)"""


@query(f"WITH {PAIRS_ALL} SELECT q_id, g_id, CAST(rank AS INTEGER) AS rank, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, g_id) AS rank FROM pairs) WHERE rank <= 10")
def retrieval_topk_all(spark, sf_dir):
    """The gallery is the whole table but the query itself."""
    rows = table(spark, sf_dir, "embeddings")
    side = lambda p: rows.select(F.col("vec_id").alias(f"{p}_id"), F.col("embedding").alias(f"{p}_vec"))
    pairs = retrieval.distances(side("q").where("q_id % 50 = 0"), side("g")).where("q_id <> g_id")
    return retrieval.top_k(pairs, 10).select("q_id", "g_id", "rank", F.round("dist", 9).alias("dist"))


@query(f"WITH {RANKED} SELECT count(*) AS valid_queries, round(avg(ap), 9) AS map, round(avg((first <= 1)::INTEGER), 9) AS cmc_1, round(avg((first <= 5)::INTEGER), 9) AS cmc_5, round(avg((first <= 10)::INTEGER), 9) AS cmc_10 FROM each")
def reid_cmc_map(spark, sf_dir):
    r = lambda c: F.round(c, 9).alias(c)
    return retrieval.cmc_map(_pairs(spark, sf_dir)).select("valid_queries", r("map"), r("cmc_1"), r("cmc_5"), r("cmc_10"))


@query(f"WITH {RANKED} SELECT CAST(r AS INTEGER) AS rank, round(avg((first <= r)::INTEGER), 9) AS cmc FROM each, range(1, 51) t(r) GROUP BY r")
def cmc_curve(spark, sf_dir):
    return retrieval.cmc_curve(_pairs(spark, sf_dir)).select("rank", F.round("cmc", 9).alias("cmc"))


def _neighbours(spark, sf_dir, k=20):
    q, g = _sides(spark, sf_dir)
    near = retrieval.top_k(retrieval.distances(q, g, V.dot), k, descending=True)
    return near.select("q_id", "rank", F.col("dist").alias("sim"), F.col("g_pid").alias("label"), "q_pid")


VOTES = f"""sims AS (SELECT q.vec_id AS q_id, q.label AS q_pid, g.vec_id AS g_id, g.label AS label, {sql_dot("q.embedding", "g.embedding")} AS sim FROM embeddings q, embeddings g WHERE q.vec_id % 50 = 0 AND g.vec_id % 50 <> 0),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, g_id) AS rank FROM sims) WHERE rank <= 20),
    e AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY q_id)) / 0.07::DOUBLE) AS e FROM near), p AS (SELECT *, e / sum(e) OVER (PARTITION BY q_id) AS p FROM e),
    votes AS (SELECT q_id, q_pid, k, label, sum(p) AS score FROM p, (VALUES (5), (10), (20)) t(k) WHERE rank <= k GROUP BY ALL),
    pred AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, k ORDER BY round(score, 12) DESC, label) AS place FROM votes) WHERE place = 1)"""


@query(f"WITH {VOTES} SELECT q_id, k, label, round(score, 9) AS score FROM votes")
def knn_soft_vote(spark, sf_dir):
    return retrieval.soft_vote(_neighbours(spark, sf_dir), (5, 10, 20)).select("q_id", "k", "label", F.round("score", 9).alias("score"))


@query(f"WITH {VOTES} SELECT k, round(100 * avg((label = q_pid)::INTEGER), 9) AS micro, round(avg(acc), 9) AS macro FROM (SELECT *, 100 * avg((label = q_pid)::INTEGER) OVER (PARTITION BY k, q_pid) AS acc FROM pred) GROUP BY k")
def knn_accuracy(spark, sf_dir):
    near = _neighbours(spark, sf_dir)
    found = retrieval.predicted(retrieval.soft_vote(near, (5, 10, 20))).join(near.select("q_id", "q_pid").distinct(), "q_id")
    hit = (F.col("label") == F.col("q_pid")).cast("double")
    each = found.groupBy("k", "q_pid").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    weighted = F.sum(100 * F.col("hits") / F.col("n") * F.col("n")) / F.sum("n")
    return each.groupBy("k").agg(F.round(100 * F.sum("hits") / F.sum("n"), 9).alias("micro"), F.round(weighted, 9).alias("macro"))


@query(f"WITH {VOTES}, first AS (SELECT q_id, q_pid, list(label ORDER BY rank) AS ranking FROM near GROUP BY ALL) SELECT k, round(100 * avg(list_contains(ranking[1:k], q_pid)::INTEGER), 9) AS accuracy FROM first, (VALUES (1), (5), (10)) t(k) GROUP BY k")
def topk_accuracy(spark, sf_dir):
    near = _neighbours(spark, sf_dir).groupBy("q_id", "q_pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]).alias("ranking"))
    parts = [near.agg(metrics.top_k_accuracy(k, F.col("ranking"), F.col("q_pid")).alias("accuracy")).select(F.lit(k).alias("k"), F.round("accuracy", 9).alias("accuracy")) for k in (1, 5, 10)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 5")
def n_per_class_sample(spark, sf_dir):
    return retrieval.per_class_sample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 5, "label", "vec_id")


def _vectors(spark, sf_dir, group):
    """The vectors by group; those without one meet nothing."""
    rows = table(spark, sf_dir, "embeddings").select(group.cast("string").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 4 == 0).alias("query"))
    return rows.where("group IS NOT NULL")


RERANK = f"""d0 AS (SELECT a.vec_id AS i, b.vec_id AS j, {sql_distance("a.embedding", "b.embedding")} AS d FROM embeddings a, embeddings b WHERE a.label = b.label),
    d AS (SELECT j AS i, i AS j, d / max(d) OVER (PARTITION BY j) AS d FROM d0),
    l AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d),
    full_ AS (SELECT a.i, a.j FROM l a JOIN l b ON a.i = b.j AND a.j = b.i WHERE a.r <= 7 AND b.r <= 7),
    half AS (SELECT a.i, a.j FROM l a JOIN l b ON a.i = b.j AND a.j = b.i WHERE a.r <= 4 AND b.r <= 4)"""

#: The same over the whole table, as the reference compares every vector with all others.
RERANK_ALL = RERANK.replace(" WHERE a.label = b.label", "")


@query(f"WITH {RERANK_ALL} SELECT i, j FROM full_")
def k_reciprocal_neighbors(spark, sf_dir):
    """Every vector against all others, whatever its label. The 6 + 1 nearest define the neighbours, as in the reference, and cap no work."""
    return retrieval.reciprocal_vectors(_vectors(spark, sf_dir, F.lit("")), 6)


@query(f"WITH {RERANK_ALL} SELECT i, j FROM full_")
def k_reciprocal_neighbors_all(spark, sf_dir):
    """The older name of the whole job."""
    return k_reciprocal_neighbors(spark, sf_dir)


RERANKED = """good AS (SELECT f.i, f.j FROM full_ f JOIN half h ON f.j = h.i LEFT JOIN full_ g ON g.i = f.i AND g.j = h.j GROUP BY ALL HAVING 3 * count(g.i) > 2 * count(*)),
    ex AS (SELECT i, j FROM full_ UNION SELECT good.i, half.j FROM good JOIN half ON good.j = half.i),
    v0 AS (SELECT i, j, exp(-d) / sum(exp(-d)) OVER (PARTITION BY i) AS w FROM ex JOIN d USING (i, j)),
    v AS (SELECT l.i, v0.j, sum(w) / 3 AS w FROM l JOIN v0 ON l.j = v0.i WHERE l.r <= 3 GROUP BY ALL),
    m AS (SELECT a.i, b.i AS j, sum(least(a.w, b.w)) AS m FROM v a JOIN v b ON a.j = b.j WHERE a.i % 4 = 0 GROUP BY ALL)
    SELECT d.i, d.j, round((1 - coalesce(m, 0) / (2 - coalesce(m, 0))) * 0.7::DOUBLE + d.d * 0.3::DOUBLE, 6) AS dist FROM d LEFT JOIN m USING (i, j) WHERE d.i % 4 = 0 AND d.j % 4 <> 0"""


@query(f"WITH {RERANK}, {RERANKED}")
def jaccard_rerank(spark, sf_dir):
    return retrieval.rerank_vectors(_vectors(spark, sf_dir, F.col("label")), k1=6, k2=3, weight=0.3).select("i", "j", F.round("dist", 6).alias("dist"))


@query(f"WITH {RERANK_ALL}, {RERANKED}")
def jaccard_rerank_all(spark, sf_dir):
    return retrieval.rerank_vectors(_vectors(spark, sf_dir, F.lit("")), k1=6, k2=3, weight=0.3).select("i", "j", F.round("dist", 6).alias("dist"))


@query(
    """WITH n AS (SELECT label AS pid, vec_id AS img_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings),
    g AS (SELECT pid, n // 3 AS "group", list(img_id ORDER BY img_id) AS ids FROM n GROUP BY ALL)
    SELECT pid, CAST("group" AS INTEGER) AS "group", CAST(k AS INTEGER) AS place, coalesce(ids[k + 1], ids[1]) AS img_id FROM g, range(3) t(k)"""
)
def multiview_groups(spark, sf_dir):
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.col("label").alias("pid"))
    return retrieval.multiview_groups(images)


@query("SELECT CAST(max(n) AS BIGINT) AS most, count(*) AS groups FROM (SELECT count(DISTINCT label) AS n FROM (SELECT label, row_number() OVER (ORDER BY label, vec_id) - 1 AS p FROM embeddings WHERE vec_id % 50 = 0) GROUP BY p // 3)")
def multiview_check(spark, sf_dir):
    from pyspark.sql import Window

    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select((F.row_number().over(Window.orderBy("label", "vec_id")) - 1).alias("img_idx"), F.col("label").alias("pid"))
    return retrieval.vehicle_groups_are_pure(queries).select(F.col("most"), F.size("starts").cast("long").alias("groups"))


@query("SELECT count(DISTINCT label) AS n_pids, count(*) AS n_images, count(DISTINCT vec_id % 4) AS n_cams, max(vec_id % 4) + 1 AS cam_range FROM embeddings")
def dataset_stats(spark, sf_dir):
    return files.identity_statistics(table(spark, sf_dir, "embeddings").select(F.col("label").alias("pid"), F.pmod("vec_id", F.lit(4)).alias("camid")))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS INTEGER) AS label FROM orders")
def relabel_ids(spark, sf_dir):
    return files.relabelled(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pid"))).select("o_orderkey", "label")


GRAPH = """e AS (SELECT event_type AS graph_id, user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, avg(value) AS w FROM events GROUP BY ALL),
    b AS (SELECT graph_id, src, dst, sum(w) AS w FROM (SELECT graph_id, src, dst, w / 2 AS w FROM e UNION ALL SELECT graph_id, dst, src, w / 2 FROM e) GROUP BY ALL),
    a AS (SELECT graph_id, src, dst, w / greatest(sum(w) OVER (PARTITION BY graph_id, src), 1e-8::DOUBLE) AS w FROM b),
    n AS (SELECT DISTINCT graph_id, src AS node FROM a), s0 AS (SELECT graph_id, node, (node = 0)::INTEGER::DOUBLE AS s FROM n)""" + "".join(
    f""", s{k} AS (SELECT n.graph_id, n.node, 0.1::DOUBLE * (n.node = 0)::INTEGER + 0.9::DOUBLE * coalesce(f.f, 0) AS s FROM n LEFT JOIN
    (SELECT a.graph_id, a.dst AS node, sum(a.w * s.s) AS f FROM a JOIN s{k - 1} s ON s.graph_id = a.graph_id AND s.node = a.src GROUP BY ALL) f USING (graph_id, node))"""
    for k in range(1, 6)
)


def _scores(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    edges = events.select(F.col("event_type").alias("graph_id"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), F.col("value").alias("w"))
    return graph.propagate(edges, rounds=5, eps=None)


@query(f"WITH {GRAPH} SELECT graph_id, node, round(s, 9) AS score FROM s5")
def graph_propagate(spark, sf_dir):
    return _scores(spark, sf_dir).select("graph_id", "node", F.round("score", 9).alias("score"))


@query(
    f"""WITH {GRAPH}, r AS (SELECT graph_id, node, count(*) OVER (PARTITION BY graph_id) AS n, row_number() OVER (PARTITION BY graph_id ORDER BY node = 0, round(s, 12) DESC, node) AS place FROM s5)
    SELECT graph_id, node FROM r WHERE node = 0 OR place <= greatest(floor((n - 1) * 0.3::DOUBLE), 1)"""
)
def token_topk(spark, sf_dir):
    return graph.top_tokens(_scores(spark, sf_dir).withColumn("score", F.round("score", 12)), 0.3)


FRAMES = "SELECT user_id AS sequence, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events"


def _frames(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sequence"), "event_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame_idx"))


@query(
    f"""WITH f AS ({FRAMES}), q AS (SELECT *, CASE WHEN frame_idx % 12 = 0 THEN 'I' ELSE 'P' END AS kind, CASE WHEN frame_idx % 12 = 0 THEN 30 ELSE 30 + [0, 1, 0, 2, 0, 2, 0, 2][(frame_idx % 8 + 1)::INTEGER] END AS qp FROM f)
    SELECT event_id, kind, qp, frame_idx % 12 <> 0 AND frame_idx % 9 = 1 AS reset, CASE WHEN kind = 'P' THEN lag(qp) OVER (PARTITION BY sequence ORDER BY frame_idx) END AS last_qp FROM q"""
)
def frame_schedule(spark, sf_dir):
    return video.schedule(_frames(spark, sf_dir), 12, 9, 30).select("event_id", "kind", "qp", "reset", "last_qp")


@query(
    f"""WITH f AS ({FRAMES}), u AS (SELECT sequence, event_type, min(frame_idx) AS first_use FROM f GROUP BY ALL), s AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY sequence ORDER BY first_use) - 1 AS INTEGER) AS sps_id FROM u)
    SELECT event_id, sps_id, frame_idx = first_use AS writes_sps FROM f JOIN s USING (sequence, event_type)"""
)
def sps_first_seen(spark, sf_dir):
    return video.parameter_sets(_frames(spark, sf_dir), ["event_type"]).select("event_id", "sps_id", "writes_sps")


@query("SELECT turn, CAST(sum(2 + CASE WHEN strlen(text) < 128 THEN 1 WHEN strlen(text) < 16384 THEN 2 ELSE 4 END + strlen(text) + CASE WHEN turn = 0 THEN 9 ELSE 0 END) AS BIGINT) AS bytes FROM conversations GROUP BY turn")
def picture_bytes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("turn").agg(F.sum(video.picture_bytes(F.col("text"), F.col("turn") == 0, 9)).cast("long").alias("bytes"))
