"""Queries of single operators that no task query exercises: joins, orders, bounds, draws, sums of losses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import quantise, vectors
from tessera.operators import detection, entropy, graph, metrics, rate, relational, retrieval
from tessera.plans import report
from tessera.plans.registry import query, sql_dot, table
from tessera.sources import joined

# Vectors and bounds


@query(f"SELECT vec_id, round(embedding[1]::DOUBLE / greatest(sqrt({sql_dot('embedding', 'embedding')}), 1e-12::DOUBLE), 9) AS first, 1.0::DOUBLE AS length FROM embeddings")
def l2_normalised(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("unit", vectors.l2_normalise(F.col("embedding")))
    return rows.select("vec_id", F.round(F.get("unit", F.lit(0)), 9).alias("first"), F.round(vectors.norm(F.col("unit")), 9).alias("length"))


@query("SELECT l_returnflag, round(sum(greatest(l_quantity, 10.0::DOUBLE)), 4) AS above, round(sum(least(l_quantity, 30.0::DOUBLE)), 4) AS below, round(sum(round_even(l_extendedprice / 1000, 0)), 4) AS rounded FROM lineitem GROUP BY 1")
def bounds_and_rounding(spark, sf_dir):
    value = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(quantise.lower_bound(value, 10)), 4).alias("above"), F.round(F.sum(quantise.upper_bound(value, 30)), 4).alias("below"),
        F.round(F.sum(quantise.round_half_even(F.col("l_extendedprice") / 1000)), 4).alias("rounded"),
    )


@query("SELECT n_nationkey AS g, (x / 12)::DOUBLE AS p_low, x::INTEGER AS label, round((x + 1) / 12.0::DOUBLE, 12) AS cdf FROM nation, range(12) t(x)")
def uniform_cdf(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("g"))
    found = entropy.cumulative(entropy.uniform_pmf(groups, 12))
    return found.select("g", (F.col("label") / 12).alias("p_low"), "label", F.round("cdf", 12).alias("cdf"))



@query(
    """WITH s AS (SELECT l_linenumber::DOUBLE - 3 AS x FROM lineitem), e AS (SELECT x, unnest([(x + 0.5) / (2.0::DOUBLE * sqrt(2.0::DOUBLE)), (x - 0.5) / (2.0::DOUBLE * sqrt(2.0::DOUBLE))]) AS z, unnest([1, -1]) AS side FROM (SELECT DISTINCT x FROM s)),
    t AS (SELECT x, side, z, 1 / (1 + 0.3275911::DOUBLE * abs(z)) AS t FROM e),
    m AS (SELECT x, sum(side * 0.5::DOUBLE * (1 + sign(z) * (1 - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z)))) AS mass FROM t GROUP BY x)
    SELECT s.x AS x, count(*) AS n, round(sum(-log2(greatest(mass, 1e-9::DOUBLE))), 4) AS bits FROM s JOIN m ON s.x = m.x GROUP BY s.x"""
)
def gaussian_rate(spark, sf_dir):
    x = F.col("l_linenumber").cast("double") - 3
    return table(spark, sf_dir, "lineitem").select(x.alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.round(F.sum(entropy.gaussian_bits(F.col("x"), 2.0)), 4).alias("bits"))


# Joins


@query(
    """SELECT coalesce(a.n_name, b.n_name) AS n_name, count(*) AS customers FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) a ON c.c_nationkey = a.n_nationkey
    LEFT JOIN (SELECT * FROM nation WHERE n_regionkey BETWEEN 1 AND 3) b ON c.c_nationkey = b.n_nationkey WHERE coalesce(a.n_name, b.n_name) IS NOT NULL GROUP BY 1"""
)
def coalesced_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    found = joined.coalesced_lookup(table(spark, sf_dir, "customer"), "c_nationkey", nation.where("n_regionkey < 2"), nation.where("n_regionkey BETWEEN 1 AND 3"), "n_name")
    return found.groupBy("n_name").agg(F.count("*").alias("customers"))


@query("SELECT d.doc_id::VARCHAR AS name, source AS left_path, quality::VARCHAR AS right_path FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def paired_names(spark, sf_dir):
    name = F.col("doc_id").cast("string").alias("name")
    left, right = table(spark, sf_dir, "documents").select(name, F.col("source").alias("path")), table(spark, sf_dir, "labels").select(name, F.col("quality").cast("string").alias("path"))
    return joined.paired(left, right)


@query("SELECT o_orderkey::VARCHAR AS name, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def feature_sets(spark, sf_dir):
    name = F.col("o_orderkey").cast("string").alias("name")
    orders = table(spark, sf_dir, "orders")
    return joined.feature_sets({"status": orders.select(name, F.col("o_orderstatus").alias("path")), "priority": orders.select(name, F.col("o_orderpriority").alias("path"))})


@query("SELECT doc_id::VARCHAR AS stem, source, d.lang AS path, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM (SELECT doc_id, source, lang FROM documents) d JOIN (SELECT doc_id, quality FROM labels WHERE quality = 1) q USING (doc_id) LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) t USING (doc_id)")
def multi_task_rows(spark, sf_dir):
    stem = F.col("doc_id").cast("string").alias("stem")
    labels, images = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select(stem, "source", F.col("lang").alias("path"))
    notes = {k: labels.where(f"{k} = 1").select(stem, F.col(k).cast("string").alias("path")) for k in ("quality", "toxic")}
    return joined.multi_task(images, notes, required=("quality",))


@query("SELECT n, l.c_name AS left_name, r.s_name AS right_name FROM (SELECT c_custkey AS n, c_name FROM customer) l JOIN (SELECT s_suppkey AS n, s_name FROM supplier) r USING (n)")
def positional_zip(spark, sf_dir):
    """Two lists side by side by position; the longer one is cut to the other's length first, as rows that differ in number are an error."""
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("right_name"))
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), F.col("c_name").alias("left_name"))
    return relational.positional(left.join(right, "n", "left_semi"), right, ["n"])


@query("SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS low, CAST(max(n_nationkey) AS BIGINT) AS high, 2 AS entries FROM nation GROUP BY 1")
def disjoint_merge(spark, sf_dir):
    sums = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sum("n_nationkey").cast("long").alias("a"), F.max("n_nationkey").cast("long").alias("b"))
    merged = sums.withColumn("m", report.disjoint(F.create_map(F.lit("low"), F.col("a")), F.create_map(F.lit("high"), F.col("b"))))
    return merged.select("n_regionkey", F.col("m")["low"].alias("low"), F.col("m")["high"].alias("high"), F.size("m").alias("entries"))


# Orders


@query("SELECT r_name, CAST(row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 99 END, r_name) AS INTEGER) AS place FROM region")
def custom_order(spark, sf_dir):
    order = report.layer_order(F.col("r_name"), {"EUROPE": 1, "ASIA": 2})
    return table(spark, sf_dir, "region").select("r_name", F.row_number().over(Window.orderBy(order, "r_name")).alias("place"))


@query(
    """WITH n AS (SELECT label AS pid, vec_id AS img_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings), g AS (SELECT pid, CAST(k // 3 AS INTEGER) AS "group", list(img_id ORDER BY img_id) AS ids FROM n GROUP BY 1, 2)
    SELECT CAST(row_number() OVER (ORDER BY "group", pid) AS INTEGER) AS turn, pid, "group", ids[1] AS first FROM g"""
)
def round_robin_turns(spark, sf_dir):
    """Groups of an identity in turn over identities: all first groups, then all second ones."""
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.col("label").alias("pid"))
    turns = retrieval.multiview_groups(images).where("place = 0")
    return turns.select(F.row_number().over(Window.orderBy("group", "pid")).alias("turn"), "pid", "group", F.col("img_id").alias("first"))


# Draws, integrals, estimates


@query("SELECT label, vec_id, CAST(drawn AS INTEGER) AS drawn FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id::VARCHAR), vec_id) AS drawn FROM embeddings) WHERE drawn <= 5")
def random_per_class(spark, sf_dir):
    return retrieval.random_per_class(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id", 5, seed=7)


@query(
    """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)),
    c AS (SELECT user_id, event_id, k, k / n AS recall, sum((event_type = 'click')::INTEGER) OVER (PARTITION BY user_id ORDER BY k) / k AS precision FROM r), s AS (SELECT user_id, (recall - coalesce(lag(recall) OVER (PARTITION BY user_id ORDER BY k), 0)) * precision AS part FROM c)
    SELECT user_id, round(sum(part), 9) AS area FROM s GROUP BY 1"""
)
def step_integral(spark, sf_dir):
    ranked = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id").withColumns({"k": F.row_number().over(ranked), "n": F.count("*").over(Window.partitionBy("user_id"))})
    hits = F.sum((F.col("event_type") == "click").cast("int")).over(Window.partitionBy("user_id").orderBy("k"))
    curve = rows.withColumns({"recall": F.col("k") / F.col("n"), "precision": hits / F.col("k")})
    return detection.step_integral(curve, "user_id", "k", "recall", "precision").select("user_id", F.round("area", 9).alias("area"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, TRUE AS near FROM lineitem GROUP BY 1")
def approx_distinct_error(spark, sf_dir):
    """The estimate lies within a tenth of the exact count."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("guess"), F.count_distinct("l_partkey").alias("parts"))
    return rows.select("l_returnflag", "parts", (F.abs(F.col("guess") - F.col("parts")) <= 0.1 * F.col("parts")).alias("near"))


@query("SELECT label, CAST(i - 1 AS INTEGER) AS place, count(*) AS n, round(avg(x::DOUBLE), 6) AS mean, round(var_samp(x::DOUBLE), 6) AS variance FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def feature_moments(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return each.groupBy("label", "place").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.var_samp(F.col("x").cast("double")), 6).alias("variance"))


# Losses, parts, sizes

PART_ROWS = "SELECT CASE WHEN l_linenumber = 7 THEN 255 ELSE l_linenumber - 1 END AS gt, CAST(l_quantity AS INTEGER) % 6 AS pred FROM lineitem"


@query(
    f"""WITH r AS (SELECT * FROM ({PART_ROWS}) WHERE gt <> 255), p AS (SELECT k, (SELECT count(*) FROM r WHERE gt = k AND pred = k) AS tp, (SELECT count(*) FROM r WHERE gt = k OR pred = k) AS u FROM range(7) t(k))
    SELECT round(100 * avg(tp / greatest(u::DOUBLE, 1e-8::DOUBLE)), 9) AS miou FROM p"""
)
def human_parts_miou(spark, sf_dir):
    gt = F.when(F.col("l_linenumber") == 7, 255).otherwise(F.col("l_linenumber") - 1)
    rows = table(spark, sf_dir, "lineitem").select(gt.alias("gt"), (F.col("l_quantity").cast("int") % 6).alias("pred"))
    return metrics.parts_iou(rows, "pred", "gt").select(F.round("miou", 9).alias("miou"))


@query("SELECT l_returnflag, round(2.5::DOUBLE * avg(l_discount) + avg(l_tax) + 0.1::DOUBLE * avg(l_quantity), 9) AS loss FROM lineitem GROUP BY 1")
def weighted_losses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in ("l_discount", "l_tax", "l_quantity")])
    loss = rate.weighted_losses(F.col("l_discount"), {"cls": F.col("l_tax"), "patch": F.col("l_quantity")}, 2.5, {"patch": 0.1})
    return rows.select("l_returnflag", F.round(loss, 9).alias("loss"))


@query("SELECT p_partkey, round(8000 / (p_size * (p_size + 3)), 9) AS bpp, round(8000 / ((ceil(p_size / 16) * 16) * (ceil((p_size + 3) / 16) * 16)), 9) AS bpp_padded FROM part")
def original_size_reset(spark, sf_dir):
    """Bits a pixel by the size before padding, and after padding with the denominator set anew."""
    up = lambda c: F.ceil(F.col(c) / 16) * 16
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("h"), (F.col("p_size") + 3).alias("w"))
    samples = rate.with_original_size(rows).withColumns({"before": F.lit(8000) / (F.col("ori_h") * F.col("ori_w")), "h": up("h"), "w": up("w")})
    return rate.with_original_size(samples).select("p_partkey", F.round("before", 9).alias("bpp"), F.round(F.lit(8000) / (F.col("ori_h") * F.col("ori_w")), 9).alias("bpp_padded"))


@query("SELECT label AS graph_id, count(*) AS patches FROM embeddings GROUP BY 1")
def checked_tokens(spark, sf_dir):
    """Tokens of a graph with distinct original places pass the check; a class token is added to each."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("graph_id"), (F.col("vec_id") + 1).alias("node"), F.col("vec_id").alias("original"))
    tokens = rows.union(rows.select("graph_id", F.lit(0).cast("long"), F.lit(-1).cast("long")).distinct())
    return graph.checked_tokens(tokens).where("node > 0").groupBy("graph_id").agg(F.count("*").alias("patches"))


@query("SELECT p_partkey, round((p_size // 2) / p_size, 9) AS keep_ratio, round(((p_size // 2) + 1) * 64 / (p_size * 8), 9) AS feature_bpfp FROM part WHERE p_size > 1")
def checked_rates(spark, sf_dir):
    """Rates of groupings whose counts are checked."""
    rows = table(spark, sf_dir, "part").where("p_size > 1").select("p_partkey", F.col("p_size").alias("tokens"), F.floor(F.col("p_size") / 2).alias("kept"))
    found = rate.grouping_row(F.col("kept"), F.col("tokens"), (F.col("kept") + 1) * 64, F.lit(8), F.lit(8), (F.col("tokens") + 1) * 64)
    return rows.select("p_partkey", *[F.round(found[k], 9).alias(k) for k in ("keep_ratio", "feature_bpfp")])


@query("SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS digest FROM nation")
def nested_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", report.nested_hash(F.struct("n_nationkey", "n_name")).alias("digest"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 100000 <= 1 THEN round(o_totalprice / 1000, 9) ELSE round(o_totalprice / 100000, 9) END AS value FROM orders")
def percent_units(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(report.percent(F.col("o_totalprice") / 100000), 9).alias("value"))


@query(
    """SELECT p_partkey, CAST(greatest(round_even(p_size / 14.0::DOUBLE, 0) * 14, 14) AS INTEGER) AS near_h, CAST(ceil(p_size / 14.0::DOUBLE) * 14 AS INTEGER) AS pad_h, CAST(ceil((p_size + 5) / 14.0::DOUBLE) * 14 AS INTEGER) AS pad_w,
    CAST(floor((ceil(p_size / 14.0::DOUBLE) * 14 - p_size) / 2) AS INTEGER) AS top FROM part"""
)
def adapted_sizes(spark, sf_dir):
    h, w = F.col("p_size"), F.col("p_size") + 5
    rows = table(spark, sf_dir, "part").select("p_partkey", joined.adapted_size(h, w, 14, True).alias("pad"), joined.adapted_size(h, w, 14, False).alias("near"))
    return rows.select("p_partkey", F.col("near.h").alias("near_h"), F.col("pad.h").alias("pad_h"), F.col("pad.w").alias("pad_w"), F.col("pad.top").alias("top"))
