"""Queries of task metrics, geometry, sources, reports and what Spark has itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import shapes, text
from tessera.operators import container, detection, distribution, entropy, geometry, metrics, probe, relational, retrieval, tiles
from tessera.plans import report
from tessera.plans.registry import query, sql_distance, table
from tessera.plans.retrieval_queries import _sides
from tessera.sources import files
from tessera.streaming import frames as streams

# Classes: the label of the nearest other vector against the own one


def _predictions(spark, sf_dir):
    q, g = _sides(spark, sf_dir)
    return retrieval.top_k(retrieval.distances(q, g), 3).select("q_id", F.col("g_pid").alias("pred"), F.col("q_pid").alias("gt"))


PRED = f"""pred AS (SELECT q_id, g_pid AS pred, q_pid AS gt FROM (SELECT q.vec_id AS q_id, q.label AS q_pid, g.label AS g_pid, row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_distance("q.embedding", "g.embedding")}, g.vec_id) AS r
    FROM embeddings q, embeddings g WHERE q.vec_id % 50 = 0 AND g.vec_id % 50 <> 0) WHERE r <= 3),
    conf AS (SELECT g::INTEGER AS gt, p::INTEGER AS pred, (SELECT count(*) FROM pred x WHERE x.gt = g AND x.pred = p) AS n FROM range(12) a(g), range(12) b(p)),
    iou AS (SELECT c AS class, tp, gn, pn, CASE WHEN gn + pn - tp > 0 THEN tp::DOUBLE / (gn + pn - tp) END AS iou FROM (SELECT c, (SELECT n FROM conf WHERE gt = c AND pred = c) AS tp, (SELECT sum(n) FROM conf WHERE gt = c) AS gn, (SELECT sum(n) FROM conf WHERE pred = c) AS pn FROM range(12) t(c)))"""


@query(f"WITH {PRED} SELECT gt, pred, n FROM conf")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_predictions(spark, sf_dir), "pred", "gt", 12)


@query(f"WITH {PRED} SELECT round(avg(iou), 9) AS miou FROM iou")
def miou_nan(spark, sf_dir):
    return metrics.mean_iou(metrics.confusion(_predictions(spark, sf_dir), "pred", "gt", 12)).select(F.round("miou", 9).alias("miou"))


@query(f"WITH {PRED} SELECT round(100 * avg(coalesce(iou, 0)), 9) AS miou FROM iou")
def miou_zero(spark, sf_dir):
    return metrics.mean_iou_percent(metrics.confusion(_predictions(spark, sf_dir), "pred", "gt", 12)).select(F.round("miou", 9).alias("miou"))


@query(f'WITH {PRED} SELECT gt AS "class", count(*) AS n, round(100 * avg((pred = gt)::INTEGER), 9) AS accuracy FROM pred GROUP BY gt')
def class_accuracy(spark, sf_dir):
    return metrics.class_accuracy(_predictions(spark, sf_dir), "pred", "gt").select("class", "n", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {PRED} SELECT round(100 * avg((pred = gt)::INTEGER), 9) AS accuracy FROM pred")
def scene_accuracy(spark, sf_dir):
    return _predictions(spark, sf_dir).agg(F.round(100 * F.avg((F.col("pred") == F.col("gt")).cast("double")), 9).alias("accuracy"))


@query(
    """WITH t AS (SELECT user_id, list_sort(list(DISTINCT CASE WHEN event_type = 'error' THEN -1 ELSE length(event_type) END)) AS targets, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) % 9 AS p FROM events GROUP BY 1)
    SELECT round(100 * avg(list_contains(list_filter(targets, lambda x: x >= 0), p)::INTEGER), 9) AS accuracy FROM t WHERE length(list_filter(targets, lambda x: x >= 0)) > 0"""
)
def multilabel_accuracy(spark, sf_dir):
    label = F.when(F.col("event_type") == "error", -1).otherwise(F.length("event_type")).cast("long")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(label).alias("targets"), (F.max(F.get_json_object("props", "$.k").cast("long")) % 9).alias("p"))
    return rows.agg(F.round(metrics.multilabel_accuracy(F.col("p"), F.col("targets")), 9).alias("accuracy"))


@query(
    """SELECT CAST(sum((quality = 1 AND toxic = 1)::INTEGER) AS BIGINT) AS tp, CAST(sum((quality = 1 AND toxic <> 1)::INTEGER) AS BIGINT) AS fp, CAST(sum((quality <> 1 AND toxic = 1)::INTEGER) AS BIGINT) AS fn,
    round(sum((quality = 1 AND toxic = 1)::INTEGER) / sum((quality = 1 OR toxic = 1)::INTEGER), 9) AS jaccard, round(sum((quality = 1 AND toxic = 1)::INTEGER) / (sum((quality = 1)::INTEGER) + 1e-12::DOUBLE), 9) AS precision,
    round(sum((quality = 1 AND toxic = 1)::INTEGER) / (sum((toxic = 1)::INTEGER) + 1e-12::DOUBLE), 9) AS recall FROM labels"""
)
def jaccard_tpfpfn(spark, sf_dir):
    found = metrics.jaccard(F.col("quality") == 1, F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").agg(*[(v if k in ("tp", "fp", "fn") else F.round(v, 9)).alias(k) for k, v in found.items()])


# Pixels: prices against quantities, and events


@query(
    """WITH p AS (SELECT 1 / (1 + exp(-(value / 490 * 255) / 255.0::DOUBLE)) AS p, (event_type = 'error')::INTEGER AS t FROM events), h AS (SELECT k, sum(CASE WHEN p >= k * 0.05::DOUBLE THEN t ELSE 0 END)::DOUBLE AS tp, sum((p >= k * 0.05::DOUBLE)::INTEGER)::DOUBLE AS pp, sum(t)::DOUBLE AS ap FROM p, range(1, 20) r(k) GROUP BY k),
    f AS (SELECT CASE WHEN pp = 0 OR ap = 0 OR tp = 0 THEN 0 ELSE 1.3::DOUBLE * (tp / pp) * (tp / ap) / (0.3::DOUBLE * (tp / pp) + tp / ap) END AS f FROM h) SELECT round(100 * max(f), 6) AS max_f FROM f"""
)
def saliency_maxf(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("value") / 490 * 255).alias("pred"), (F.col("event_type") == "error").cast("int").alias("target"))
    return metrics.saliency_max_f(rows, "pred", "target").select(F.round("max_f", 6).alias("max_f"))


@query(
    """SELECT round(avg(0.95::DOUBLE * t * s + 0.05::DOUBLE * (1 - t) * (s + x)), 9) AS loss FROM (SELECT x, t, greatest(-x, 0) + ln(1 + exp(-abs(x))) AS s FROM (SELECT value / 255 AS x, (event_type = 'error')::INTEGER AS t FROM events))"""
)
def edge_bce(spark, sf_dir):
    loss = metrics.balanced_edge_loss(F.col("value") / 255, (F.col("event_type") == "error").cast("int"))
    return table(spark, sf_dir, "events").agg(F.round(loss, 9).alias("loss"))


POOLED = """count(*) AS n, round(sqrt(avg((g - p) * (g - p))), 6) AS rmse, round(sqrt(avg((ln(g) - ln(p)) * (ln(g) - ln(p)))), 6) AS log_rmse, round(avg(abs(g - p) / g), 6) AS abs_rel, round(avg((g - p) * (g - p) / g), 6) AS sq_rel"""


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_extendedprice") / 2000 - 1).alias("pred"), F.col("l_quantity").alias("gt"))


PIXELS = "SELECT l_suppkey AS image, CASE WHEN l_extendedprice / 2000 - 1 <= 0 THEN 1e-9::DOUBLE ELSE l_extendedprice / 2000 - 1 END AS p, l_quantity AS g FROM lineitem"


def _rounded(df):
    return df.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "log_rmse", "abs_rel", "sq_rel")])


@query(f"SELECT {POOLED} FROM ({PIXELS}) WHERE g > 2 AND g < 45")
def depth_pooled(spark, sf_dir):
    return _rounded(metrics.depth_pooled(_pixels(spark, sf_dir), "pred", "gt", low=2, high=45))


@query(f"SELECT {POOLED} FROM ({PIXELS}) WHERE g <> 7")
def depth_legacy(spark, sf_dir):
    return _rounded(metrics.depth_pooled(_pixels(spark, sf_dir), "pred", "gt", ignore=7))


PER_IMAGE = """SELECT image, avg((r < 1.25)::INTEGER) AS a1, avg((r < 1.5625)::INTEGER) AS a2, avg((r < 1.953125)::INTEGER) AS a3, avg(abs(e) / g) AS abs_rel, sqrt(avg(e * e)) AS rmse, avg(abs(log10(g) - log10(p))) AS log_10, sqrt(avg(l * l)) AS rmse_log,
    100 * sqrt(greatest(avg(l * l) - avg(l) * avg(l), 0)) AS silog, avg(e * e / g) AS sq_rel, avg(abs(e)) AS mae FROM (SELECT image, g, p, greatest(g / p, p / g) AS r, g - p AS e, ln(g) - ln(p) AS l FROM
    (SELECT l_suppkey AS image, l_quantity AS g, greatest(1.0::DOUBLE, least(48.0::DOUBLE, l_extendedprice / 2000 - 1)) AS p FROM lineitem) WHERE g > 1 AND g < 48) GROUP BY image"""


@query("SELECT " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in metrics.DEPTH_NAMES) + f" FROM ({PER_IMAGE})")
def depth_per_image(spark, sf_dir):
    found = metrics.mean_over_images(metrics.depth_per_image(_pixels(spark, sf_dir), "image", "pred", "gt", 1.0, 48.0, 1.0))
    return found.select(*[F.round(n, 6).alias(n) for n in metrics.DEPTH_NAMES])


@query("SELECT p_partkey, p_size * 480 // 50 BETWEEN floor(45 / 480.0::DOUBLE * 240) AND floor(471 / 480.0::DOUBLE * 240) - 1 AND 50 BETWEEN floor(41 / 640.0::DOUBLE * 320) AND floor(601 / 640.0::DOUBLE * 320) - 1 AS inside FROM part")
def eigen_crop(spark, sf_dir):
    y = F.floor(F.col("p_size") * 480 / 50)
    return table(spark, sf_dir, "part").select("p_partkey", metrics.eigen_crop(y, F.lit(50), F.lit(240), F.lit(320)).alias("inside"))


def _unit(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"list_transform({v}, lambda x: x / {n})"


@query(
    f"""SELECT label, round(avg(degrees(2 * atan2(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) * (z[1] + z[2]))))))), 6) AS angle
    FROM (SELECT label, {_unit("a")} AS a, {_unit("b")} AS b FROM (SELECT label, embedding[1:3]::DOUBLE[] AS a, embedding[4:6]::DOUBLE[] AS b FROM embeddings)) GROUP BY label"""
)
def normals_angle(spark, sf_dir):
    part = lambda k: F.slice("embedding", k, 3)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(metrics.normal_angle(part(1), part(4))), 6).alias("angle"))


ANSWERS = """SELECT role AS category, turn % 3 AS l2, trim(text) AS p, substr(trim(lag_text), 1, 1) AS a FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_text FROM conversations) WHERE lag_text IS NOT NULL"""


@query(
    f"""SELECT category, l2, count(*) AS n, round(100 * avg((p <> '' AND (right(p, 1) = a OR trim(p, '.') = a || '. ' || trim(a, '.')))::INTEGER), 9) AS accuracy FROM ({ANSWERS}) GROUP BY GROUPING SETS ((), (category), (l2))"""
)
def vqa_accuracy_grouped(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    answer = F.substring(F.trim("before"), 1, 1)
    right = text.answer_is_correct(F.col("text"), answer, F.create_map(answer, answer))
    marked = rows.select(F.col("role").alias("category"), F.pmod("turn", F.lit(3)).alias("l2"), right.cast("double").alias("hit"))
    return marked.groupingSets([[], ["category"], ["l2"]], "category", "l2").agg(F.count("*").alias("n"), F.round(100 * F.avg("hit"), 9).alias("accuracy"))


@query("SELECT prefix, count(*) AS n, round(avg(-10 * log10(greatest(mse, 1e-10::DOUBLE))), 6) AS psnr FROM (SELECT split_part(event_type || '_' || event_id, '_', 1) AS prefix, (value / 500) * (value / 500) AS mse FROM events) GROUP BY GROUPING SETS ((), (prefix))")
def psnr_by_prefix(spark, sf_dir):
    name = F.concat_ws("_", "event_type", "event_id")
    rows = table(spark, sf_dir, "events").select(text.name_prefix(name).alias("prefix"), ((F.col("value") / 500) * (F.col("value") / 500)).alias("mse"))
    return rows.groupingSets([[], ["prefix"]], "prefix").agg(F.count("*").alias("n"), F.round(F.avg(metrics.psnr(F.col("mse"))), 6).alias("psnr"))


YUV = "SELECT l_orderkey, -10 * log10(greatest(l_discount * l_discount, 1e-10::DOUBLE)) AS y, -10 * log10(greatest(l_tax * l_tax, 1e-10::DOUBLE)) AS u, -10 * log10(greatest(l_quantity / 5000, 1e-10::DOUBLE)) AS v FROM lineitem"


def _planes(spark, sf_dir):
    p = metrics.psnr
    return table(spark, sf_dir, "lineitem").select("l_orderkey", p(F.col("l_discount") * F.col("l_discount")).alias("y"), p(F.col("l_tax") * F.col("l_tax")).alias("u"), p(F.col("l_quantity") / 5000).alias("v"))


@query(f"SELECT l_orderkey, round(avg((6 * y + u + v) / 8), 6) AS psnr FROM ({YUV}) GROUP BY l_orderkey")
def yuv_psnr_611(spark, sf_dir):
    return _planes(spark, sf_dir).groupBy("l_orderkey").agg(F.round(F.avg(metrics.yuv_combined(F.col("y"), F.col("u"), F.col("v"))), 6).alias("psnr"))


@query(f"SELECT round(avg(y), 6) AS y, round(avg(u), 6) AS u, round(avg(v), 6) AS v FROM (SELECT avg(y) AS y, avg(u) AS u, avg(v) AS v FROM ({YUV}) GROUP BY l_orderkey)")
def two_level_video_mean(spark, sf_dir):
    return metrics.two_level_mean(_planes(spark, sf_dir), "l_orderkey", ["y", "u", "v"])


@query("SELECT event_type, round(avg(-10 * log10(1 - value / 500)), 6) AS db FROM events GROUP BY 1")
def ms_ssim_db(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(metrics.ms_ssim_db(F.col("value") / 500)), 6).alias("db"))


@query("SELECT round(sum(l_quantity) / count(*), 6) AS l_quantity, round(sum(l_discount) / count(*), 6) AS l_discount, round(sum(l_tax) / count(*), 6) AS l_tax FROM lineitem")
def record_mean(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax"]
    return metrics.record_mean(table(spark, sf_dir, "lineitem"), names, strict=True).select(*[F.round(n, 6).alias(n) for n in names])


@query("SELECT o_orderpriority, round(-sum(ln(o_totalprice / 600000) * w) / sum(w), 6) AS loss FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def weighted_cross_entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    weight = F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(1.0)
    return rows.groupBy("o_orderpriority").agg(F.round(metrics.cross_entropy(F.log(F.col("o_totalprice") / 600000), weight), 6).alias("loss"))


@query("SELECT l_returnflag, round(sqrt(greatest(avg(d * d) - 0.5::DOUBLE * avg(d) * avg(d), 0)), 6) AS silog, round(coalesce(avg(CASE WHEN g > 5 THEN abs(p - g) END), 0), 6) AS l1 FROM (SELECT l_returnflag, l_quantity AS g, l_extendedprice / 2000 AS p, ln(l_extendedprice / 2000) - ln(l_quantity) AS d FROM lineitem) GROUP BY 1")
def loss_values(spark, sf_dir):
    p, g = F.col("l_extendedprice") / 2000, F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.scale_invariant_log(p, g), 6).alias("silog"), F.round(metrics.masked_l1(p, g, g > 5), 6).alias("l1"))


@query("SELECT r::INTEGER AS label, round(coalesce((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * n), 0), 9) AS weight FROM range(12) t(r) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c ON c.label = r")
def balanced_weights(spark, sf_dir):
    return metrics.balanced_weights(table(spark, sf_dir, "embeddings"), "label", 12).select("label", F.round("weight", 9).alias("weight"))


@query("SELECT round(avg(CASE WHEN event_type <> 'view' THEN value END), 6) AS a, count(CASE WHEN event_type <> 'view' THEN value END) AS a_count, round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS b, count(CASE WHEN event_type = 'error' THEN value END) AS b_count FROM events")
def per_metric_mean(spark, sf_dir):
    t, v = F.col("event_type"), F.col("value")
    rows = table(spark, sf_dir, "events").select(F.when(t != "view", v).alias("a"), F.when(t == "error", v).alias("b"))
    found = metrics.per_metric_mean(rows, ["a", "b"])
    return found.select(F.round("a", 6).alias("a"), "a_count", F.round("b", 6).alias("b"), "b_count")


@query("SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS largest FROM orders WHERE o_orderkey % 4 IN (0, 2) GROUP BY 1")
def value_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderkey") % 4 / 4).alias("rho"), F.col("o_totalprice").alias("value"))
    return report.value_ranges(rows, ["o_orderpriority"], [0.0, 0.5])


@query("SELECT graph_id, label, round(p, 9) AS p, round(log2(p), 9) AS log2_p, round(least(sum(p) OVER (PARTITION BY graph_id ORDER BY label), 1), 9) AS cdf FROM (SELECT graph_id, label, exp(l) / sum(exp(l)) OVER (PARTITION BY graph_id) AS p FROM (SELECT n_regionkey AS graph_id, n_nationkey AS label, n_nationkey / 10.0::DOUBLE AS l FROM nation))")
def softmax_prior(spark, sf_dir):
    logits = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("label"), (F.col("n_nationkey") / 10).alias("logit"))
    found = entropy.cumulative(entropy.softmax_prior(logits))
    return found.select(F.col("g").alias("graph_id"), "label", *[F.round(c, 9).alias(c) for c in ("p", "log2_p", "cdf")])


@query()
def feature_distance(spark, sf_dir):
    """Frechet distance of the vectors of even and odd labels."""
    rows = table(spark, sf_dir, "embeddings")
    found = distribution.feature_distance(rows.where("label % 2 = 0"), rows.where("label % 2 = 1"), 64, "embedding")
    return spark.createDataFrame([(round(found, 6),)], "distance double")


@query("SELECT user_id, count(*) AS pictures, CAST(sum(strlen(props)) AS BIGINT) AS bytes, CAST(sum((frame_idx % 12 = 0)::INTEGER) AS BIGINT) AS intra FROM (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events) GROUP BY user_id")
def container_round_trip(spark, sf_dir):
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("sequence"), frame.alias("frame_idx"), F.col("props").cast("binary").alias("payload"), F.length("event_type").alias("h"), F.lit(16).alias("w"))
    coded = frames.withColumns({"kind": F.when(F.col("frame_idx") % 12 == 0, "I").otherwise("P"), "qp": F.lit(30)})
    found = container.pictures(container.sequences(coded))
    return found.groupBy(F.col("sequence").alias("user_id")).agg(F.count("*").alias("pictures"), F.sum("bytes").cast("long").alias("bytes"), F.sum((F.col("kind") == "I").cast("int")).cast("long").alias("intra"))


@query("SELECT user_id, CAST(ceil(count(*) * 7 / 8) AS BIGINT) AS bytes, TRUE AS round_trip FROM events GROUP BY user_id")
def index_stream_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))), lambda s: s["k"]).alias("labels"))
    coded = rows.withColumn("payload", tiles.packed_indices(F.col("labels"), 100))
    back = tiles.unpacked_indices(F.col("payload"), F.size("labels"), 100)
    return coded.select("user_id", F.octet_length("payload").cast("long").alias("bytes"), (back == F.col("labels")).alias("round_trip"))


@query()
def logistic_probe(spark, sf_dir):
    """Accuracy of linear probes on the vectors, a fifth of them held out."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    return probe.logistic_probe(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), (0.01,), 10)


# Boxes


def _boxes(spark, sf_dir):
    c = F.col
    x, y = F.pmod("l_partkey", F.lit(40)), F.pmod("l_suppkey", F.lit(40))
    box = F.array(*[v.cast("double") for v in (x, y, x + c("l_quantity"), y + 10 + c("l_linenumber"))])
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("image"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), (c("l_quantity") % 4).cast("int").alias("cls"), c("l_extendedprice").alias("score"), box.alias("box"))


BOXES = "SELECT l_orderkey AS image, l_linenumber AS n, l_partkey AS p, (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, l_partkey % 40 + l_quantity AS x2, (l_suppkey % 40 + 10 + l_linenumber)::DOUBLE AS y2 FROM lineitem"


@query(
    f"""WITH b AS ({BOXES}) SELECT image, n, other, round(i / ((x2 - x1) * (y2 - y1) + area - i + 1e-6::DOUBLE), 9) AS iou FROM
    (SELECT a.*, o.n AS other, (o.x2 - o.x1) * (o.y2 - o.y1) AS area, greatest(0, least(a.x2, o.x2) - greatest(a.x1, o.x1)) * greatest(0, least(a.y2, o.y2) - greatest(a.y1, o.y1)) AS i FROM b a JOIN b o ON a.image = o.image AND a.n < o.n)"""
)
def box_iou_pairs(spark, sf_dir):
    a = _boxes(spark, sf_dir).select("image", "n", "box")
    b = a.select("image", F.col("n").alias("other"), F.col("box").alias("other_box"))
    return a.join(b, "image").where("n < other").select("image", "n", "other", F.round(detection.iou(F.col("box"), F.col("other_box")), 9).alias("iou"))


def _detections(spark, sf_dir, thresholds):
    rows = _boxes(spark, sf_dir)
    pred = rows.where("n % 2 = 1").select("image", "cls", "score", "box")
    gt = rows.where("n % 2 = 0").select("image", "cls", "box")
    return detection.class_average_precision(pred, gt, thresholds)


@query()
def detection_ap(spark, sf_dir):
    return _detections(spark, sf_dir, (0.1,)).select("image", "cls", F.round("ap", 9).alias("ap"), "has_gt")


@query()
def detection_map(spark, sf_dir):
    found = detection.coco_summary(_detections(spark, sf_dir, tuple(0.5 + 0.05 * k for k in range(10))))
    return found.select("image", *[F.round(c, 9).alias(c) for c in ("map_50", "map_75", "map_50_95")])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max, min(value) AS min, round(median(value), 6) AS median, count(*) AS frames FROM events GROUP BY 1")
def frame_statistics(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy("event_type")
    return detection.frame_statistics(grouped, "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "max", "min", F.round("median", 6).alias("median"), "frames")


# Geometry


def _images(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") * 3 + 16).alias("h"), (F.col("p_size") * 5 + 7).alias("w"))


IMAGES = "SELECT p_partkey AS sample_id, p_size * 3 + 16 AS h, p_size * 5 + 7 AS w FROM part"
STARTS = "list_transform(range(greatest({0} - 64 + 48 - 1, 0) // 48 + 1), lambda k: greatest(least(k * 48, {0} - 64), 0))"
CROPS = f"""SELECT sample_id, (r - 1) * length(lefts) + c - 1 AS crop_idx, tops[r] AS top, lefts[c] AS "left", h, w FROM (SELECT sample_id, h, w, {STARTS.format("h")} AS tops, {STARTS.format("w")} AS lefts FROM ({IMAGES})) s, range(1, 30) a(r), range(1, 30) b(c) WHERE r <= length(tops) AND c <= length(lefts)"""


@query(f'SELECT sample_id, CAST(crop_idx AS INTEGER) AS crop_idx, CAST(top AS INTEGER) AS top, CAST("left" AS INTEGER) AS "left" FROM ({CROPS})')
def slide_crop_grid(spark, sf_dir):
    return geometry.crop_grid(_images(spark, sf_dir), 64, 48)


#: Images of a task whose pixels are fused.
CROPPED_IMAGES = 4000


@query(
    f"""WITH c AS ({CROPS}), p AS (SELECT sample_id, top + dy * 16 AS y, "left" + dx * 16 AS x, cls::INTEGER AS cls, (crop_idx + 1) * (cls + 1) AS v FROM c, range(4) a(dy), range(4) b(dx), range(2) k(cls) WHERE top + dy * 16 < h AND "left" + dx * 16 < w)
    SELECT sample_id, CAST(count(*) AS BIGINT) AS pixels, round(sum(v), 6) AS total FROM (SELECT sample_id, y, x, cls, sum(v) / count(*) AS v FROM p GROUP BY ALL) GROUP BY sample_id"""
)
def crop_fusion(spark, sf_dir):
    """Dealt out by image before its pixels become rows: both sums by image and pixel then need no shuffle of their own."""
    images = _images(spark, sf_dir)
    images = images.repartition(max(1, images.count() // CROPPED_IMAGES), "sample_id")
    step = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = geometry.crop_grid(images, 64, 48, sizes=True).withColumn("dy", step(4)).withColumn("dx", step(4)).withColumn("cls", step(2))
    values = rows.select("sample_id", (F.col("top") + F.col("dy") * 16).alias("y"), (F.col("left") + F.col("dx") * 16).alias("x"), "cls", ((F.col("crop_idx") + 1) * (F.col("cls") + 1)).cast("double").alias("value"), "h", "w").where("y < h AND x < w")
    return geometry.fuse_crops(values).groupBy("sample_id").agg(F.count("*").alias("pixels"), F.round(F.sum("value"), 6).alias("total"))


@query(f"SELECT sample_id, CAST(ceil(h / 14) * 14 AS INTEGER) AS padded_h, CAST(ceil(w / 14) * 14 AS INTEGER) AS padded_w, CAST(floor((ceil(h / 14) * 14 - h) / 2) AS INTEGER) AS top, CAST(floor((ceil(w / 14) * 14 - w) / 2) AS INTEGER) AS \"left\", h AS height, w AS width FROM ({IMAGES})")
def pad_to_multiple(spark, sf_dir):
    found = geometry.padded_shapes(_images(spark, sf_dir), 14)
    return found.select("sample_id", "padded_h", "padded_w", "valid_roi.top", "valid_roi.left", "valid_roi.height", "valid_roi.width")


@query(f"WITH s AS (SELECT *, least(1.0::DOUBLE, 100 / h::DOUBLE, 120 / w::DOUBLE) AS s FROM ({IMAGES})) SELECT sample_id, greatest(CAST(round_even(h * s, 0) AS INTEGER), 1) AS new_h, greatest(CAST(round_even(w * s, 0) AS INTEGER), 1) AS new_w FROM s")
def resize_to_fit_shape(spark, sf_dir):
    scale = shapes.fit_scale(F.col("h"), F.col("w"), 100, 120)
    return _images(spark, sf_dir).select("sample_id", shapes.resize_to_fit(F.col("h"), scale).alias("new_h"), shapes.resize_to_fit(F.col("w"), scale).alias("new_w"))


@query(f"SELECT sample_id, CAST(floor((ceil(h / 16) * 16 - h) / 2) AS INTEGER) AS before, CAST(ceil((ceil(h / 16) * 16 - h) / 2) AS INTEGER) AS after FROM ({IMAGES})")
def symmetric_padding(spark, sf_dir):
    return _images(spark, sf_dir).select("sample_id", shapes.symmetric_padding(F.col("h"), 16).alias("p")).select("sample_id", "p.before", "p.after")


@query("SELECT CASE WHEN p_size IN (1, 50) THEN 255 WHEN p_size = 255 THEN 255 ELSE p_size % 50 - 1 END AS label, count(*) AS n FROM (SELECT CASE WHEN p_size = 1 THEN 0 ELSE p_size END AS p0, p_size FROM part) GROUP BY 1")
def reduce_zero_label(spark, sf_dir):
    raw = F.when(F.col("p_size").isin(1, 50), 0).otherwise(F.col("p_size"))
    return table(spark, sf_dir, "part").groupBy(shapes.reduce_zero_label(raw).alias("label")).agg(F.count("*").alias("n"))


# Sources and relations


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def label_left_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT 'kept' AS part, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT 'missing', doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents)")
def subset_semi_join(spark, sf_dir):
    kept, missing = relational.subset(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return kept.select(F.lit("kept").alias("part"), "doc_id").union(missing.select(F.lit("missing").alias("part"), "doc_id"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN CASE WHEN strlen(html) = 5000 THEN 'ok' ELSE 'size_mismatch' END ELSE 'checksum_mismatch' END AS status FROM pages"""
)
def manifest_verify(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    check = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("sha256:"), F.sha2(F.col("html").cast("binary"), 256))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("md5:"), F.left(F.md5(F.col("html").cast("binary")), F.lit(12)))).when(F.col("page_id") % 4 == 2, "size:5000").otherwise("md5:nothex")
    lines = pages.select(F.concat_ws(" ", F.concat(F.lit("pages/"), F.col("page_id").cast("string")), check).alias("value"))
    content = pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("dest"), F.col("html").cast("binary").alias("content"))
    found = files.verify(files.manifest(lines, "https://example.org/files"), content)
    return found.select(F.split_part("dest", F.lit("/"), F.lit(2)).cast("long").alias("page_id"), "status")


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS pid, CAST(o_orderkey % 7 AS INTEGER) AS camid FROM orders")
def reid_file_names(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%04d_c%03d_x.jpg", F.col("o_custkey"), F.col("o_orderkey") % 7).alias("name"))
    junk = names.select("o_orderkey", F.lit("-1_c001.jpg").alias("name"))
    return files.identities(names.union(junk)).drop("name")


@query("SELECT o_orderkey, 'box_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::DOUBLE) AS name FROM orders")
def numbered_boxes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    body = F.to_json(F.struct(F.create_map(F.lit("box_9"), F.array(F.col("o_orderkey").cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("Object Detection")))
    found = files.structured_data(orders.select("o_custkey", body.alias("value")))
    return files.numbered(found, "o_custkey").select(F.col("box")[0].cast("long").alias("o_orderkey"), "name")


@query("SELECT page_id, replace(regexp_replace(regexp_replace(p, '\\.[^./]*$', ''), '^(train|test)/', ''), '/', '__') AS stem FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'train/' ELSE 'a/' END || split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS p FROM pages)")
def sample_stem(spark, sf_dir):
    bare = F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "train/").otherwise("a/"), bare)
    return table(spark, sf_dir, "pages").select("page_id", text.sample_stem(path).alias("stem"))


@query("SELECT conv_id, turn, text || chr(10) || 'A. ' || role || chr(10) || 'B. none' || chr(10) || 'Answer with the letter.' AS prompt FROM conversations")
def question_prompt(spark, sf_dir):
    question = F.concat(F.lit("Hint: choose.\n"), F.col("text"))
    options = F.create_map(F.lit("B"), F.lit("none"), F.lit("A"), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt(question, options, "Answer with the letter.").alias("prompt"))


# Reports

RULES = (("startswith", "https://blog.", "blog/"), ("endswith", ".html", ""), ("contains", "?utm_source=feed", ""), ("exact", "http://nowhere", "x"), ("regex", "#top$", ""), ("startswith", "http://", "plain/"), ("contains", "page=2", ""))


@query(
    """SELECT page_id, nullif(CASE WHEN starts_with(url, 'https://blog.') THEN 'blog/' || substr(url, 14) WHEN suffix(url, '.html') THEN left(url, length(url) - 5) WHEN contains(url, '?utm_source=feed') THEN replace(url, '?utm_source=feed', '') WHEN url = 'http://nowhere' THEN 'x'
    WHEN regexp_matches(url, '#top$') THEN regexp_replace(url, '#top$', '') WHEN starts_with(url, 'http://') THEN 'plain/' || substr(url, 8) WHEN contains(url, 'page=2') THEN replace(url, 'page=2', '') ELSE url END, '') AS key FROM pages"""
)
def rename_first_match(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", report.renamed(F.col("url"), RULES).alias("key"))


@query("SELECT p_partkey, CAST(p_size AS INTEGER) AS words, CAST(p_partkey % 64 AS INTEGER) AS edge, CASE WHEN p_partkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM part")
def parse_codec_name(spark, sf_dir):
    name = F.concat(F.lit("pq_k"), F.col("p_size").cast("string"), F.lit("_e"), (F.col("p_partkey") % 64).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_lambda0.25").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", report.codec_fields(name).alias("f")).select("p_partkey", "f.*")


@query(
    """WITH r AS (SELECT n_nationkey AS k, (n_nationkey % 5) / 100.0::DOUBLE AS rate, n_nationkey::DOUBLE AS value FROM nation WHERE n_nationkey % 3 <> 0)
    SELECT n_nationkey AS k, CASE WHEN n_regionkey = 4 THEN 'missing_plan' WHEN r.rate IS NULL THEN 'missing_result' WHEN round(abs(r.rate - 0.02::DOUBLE), 9) <= 0.01 AND round(abs(r.value - (n_nationkey + 0.1::DOUBLE)), 9) <= 0.2 THEN 'match' ELSE 'mismatch' END AS status FROM nation LEFT JOIN r ON r.k = n_nationkey"""
)
def reference_compare(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    refs = nation.select(F.col("n_nationkey").alias("k"), F.lit(0.02).alias("ref_rate"), (F.col("n_nationkey") + 0.1).alias("ref_value"))
    results = nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 5 / 100).alias("rate"), F.col("n_nationkey").cast("double").alias("value"))
    return report.compare(refs, results, nation.where("n_regionkey <> 4").select(F.col("n_nationkey").alias("k")), ["k"]).select("k", "status")


@query(
    """WITH v AS (SELECT event_type AS quality, 'mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'largest', max(value) FROM events WHERE event_type <> 'view' GROUP BY 1)
    SELECT metric, max(CASE WHEN quality = 'click' THEN value END) AS click, max(CASE WHEN quality = 'error' THEN value END) AS error, max(CASE WHEN quality = 'view' THEN value END) AS "view" FROM v GROUP BY metric"""
)
def multi_run_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mean = events.groupBy(F.col("event_type").alias("quality")).agg(F.round(F.avg("value"), 6).alias("value")).select("quality", F.lit("mean").alias("metric"), "value")
    most = events.where("event_type <> 'view'").groupBy(F.col("event_type").alias("quality")).agg(F.max("value").alias("value")).select("quality", F.lit("largest").alias("metric"), "value")
    order = ["click", "error", "view"]
    return report.aligned(mean.union(most), order).select("metric", *[F.col("values")[k].alias(q) for k, q in enumerate(order)])


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def upsert_last_write(spark, sf_dir):
    updates = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("column"), "value")
    return report.upserted(updates).select(F.col("id").alias("user_id"), F.col("column").alias("event_type"), "value")


@query("SELECT 'cls_' || o_orderpriority AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1 UNION ALL SELECT 'bpp', round(avg(l_quantity), 6) FROM lineitem")
def finalized_metrics(spark, sf_dir):
    records = table(spark, sf_dir, "lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("value")).select(F.lit("bpp").alias("metric"), "value")
    meters = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg("o_totalprice"), 4).alias("value")).select(F.lit("cls").alias("label"), "metric", "value")
    return report.finalized(records, meters)


@query("SELECT o_orderpriority, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END AS INTEGER) AS place, printf('%d,%.2f', count(*), sum(o_totalprice) / 1000000) AS line FROM orders GROUP BY 1")
def report_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), (F.sum("o_totalprice") / 1000000).alias("total"))
    return rows.select("o_orderpriority", report.layer_order(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1}).alias("place"), report.row_text([F.col("n"), F.col("total")], ["%d", "%.2f"]).alias("line"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000) WHERE n = 1")
def unambiguous_match(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"))
    return report.matched_once(pairs.select("c_custkey", "o_orderkey"), "c_custkey")


# What Spark has itself: beyond the reference


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    return _plain_time(streams.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour"))


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) t(k) GROUP BY ALL")
def sliding(spark, sf_dir):
    return _plain_time(streams.windowed(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "30 minutes"))


def _plain_time(df):
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def session(spark, sf_dir):
    found = streams.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("most"))


@query("SELECT e.event_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return relational.asof(left, right, "user_id", "ts", "value", "event_id").select("event_id", "last_value")


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_ops(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "customers": a.subtract(b), "either": a.union(b).distinct()}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count("*").alias("n"))


@query()
def approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))
