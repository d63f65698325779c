"""Queries of rate accounting, quantisation, codes and index sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import codes, quantise
from tessera.operators import indexset, rate
from tessera.plans.registry import query, table


@query("SELECT lang || '.' || source AS stream_key, CAST(sum(strlen(text)) * 8 AS BIGINT) AS bits FROM documents GROUP BY ALL")
def bits_from_strings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("layer"), F.col("source").alias("stream"), F.col("text").alias("payload"))
    return rate.container_bits(docs, "frame")


TURNS = "SELECT turn AS frame, role AS layer, 'text' AS stream, text FROM conversations"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("turn").alias("frame"), F.col("role").alias("layer"), F.lit("text").alias("stream"), F.col("text").alias("payload"))


@query(f"SELECT frame || '.' || layer || '.' || stream AS stream_key, CAST(sum(strlen(text)) * 8 AS BIGINT) AS bits FROM ({TURNS}) GROUP BY ALL")
def container_frame_wise(spark, sf_dir):
    return rate.container_bits(_turns(spark, sf_dir), "frame_wise_video")


@query(f"SELECT layer || '.' || frame || '.' || stream AS stream_key, CAST(sum(strlen(text)) * 8 AS BIGINT) AS bits FROM ({TURNS}) GROUP BY ALL")
def container_layer_wise(spark, sf_dir):
    return rate.container_bits(_turns(spark, sf_dir), "layer_wise_video")


@query("SELECT role AS stream_key, CAST(sum(strlen(text)) * 8 AS BIGINT) AS bits FROM conversations GROUP BY ALL")
def slide_crops_bits(spark, sf_dir):
    return rate.container_bits(_turns(spark, sf_dir).withColumn("stream", F.col("layer")), "slide_crops")


@query("SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(sum(CASE WHEN turn = 0 THEN strlen(text) * 8 ELSE 0 END) AS BIGINT) AS bits FROM conversations GROUP BY conv_id")
def bits_first_inner(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(rate.stream_bits(F.col("text"), F.col("turn")).alias("bits"))


@query(
    """WITH p AS (SELECT event_type, count(*)::DOUBLE / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1)
    SELECT event_type, round(-sum(log2(p)), 4) AS bits FROM events JOIN p USING (event_type) GROUP BY 1"""
)
def bits_from_likelihoods(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    p = events.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(events.agg(F.count("*").alias("all")))).select("event_type", (F.col("n") / F.col("all")).alias("p"))
    return events.join(F.broadcast(p), "event_type").groupBy("event_type").agg(F.round(rate.likelihood_bits(F.col("p")), 4).alias("bits"))


@query(
    """SELECT doc_id, round((strlen(text) + strlen(lang)) * 8 / greatest(1, n_chars), 6) AS bpp, round(strlen(text) * 8 / greatest(1, n_chars), 6) AS bpp_text,
    round(strlen(lang) * 8 / greatest(1, n_chars), 6) AS bpp_lang FROM documents"""
)
def bpp_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bits = docs.select(F.col("doc_id").alias("sample_id"), F.explode(F.array(F.struct(F.lit("text").alias("stream"), (F.octet_length("text") * 8).alias("bits")), F.struct(F.lit("lang").alias("stream"), (F.octet_length("lang") * 8).alias("bits")))).alias("s")).select("sample_id", "s.*")
    found = rate.record_bits_per_pixel(bits, docs.select(F.col("doc_id").alias("sample_id"), F.col("n_chars").alias("h"), F.lit(1).alias("w")))
    at = lambda s: F.round(F.col("bpp_by_stream")[s], 6)
    return found.select(F.col("sample_id").alias("doc_id"), F.round("bpp", 6).alias("bpp"), at("text").alias("bpp_text"), at("lang").alias("bpp_lang"))


@query("SELECT lang, round(sum(strlen(text) * 8)::DOUBLE / sum(n_chars)::DOUBLE, 9) AS bpfp FROM documents GROUP BY lang")
def bpfp(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(rate.bits_per_feature_value(F.octet_length("text") * 8, F.col("n_chars")), 9).alias("bpfp"))


GROUPING = """SELECT p_partkey, p_size AS tokens, p_size // 2 AS kept, (p_size // 2 + 1) * 64 AS feature_bits,
    8 * least(ceil(p_size / 8)::BIGINT, ceil((p_size // 2) * greatest(1, length(bin(p_size - 1))) / 8)::BIGINT) AS map_bits FROM part"""


def _grouping(spark, sf_dir):
    tokens = F.col("p_size")
    kept = F.floor(tokens / 2).cast("int")
    size = F.when(codes.index_coding(kept, tokens) == "index", codes.index_payload_size(kept, tokens)).otherwise(codes.bitmap_payload_size(tokens))
    return table(spark, sf_dir, "part").select("p_partkey", tokens.alias("tokens"), kept.alias("kept"), ((kept + 1) * 64).alias("feature_bits"), (8 * size).alias("map_bits"))


@query(
    f"""SELECT p_partkey, round(kept / tokens, 9) AS keep_ratio, round(feature_bits / (tokens * 8), 9) AS feature_bpfp, round(map_bits / (tokens * 8), 9) AS map_bpfp,
    round((feature_bits + map_bits) / (tokens * 8), 9) AS total_bpfp, round(map_bits / (feature_bits + map_bits), 9) AS side_fraction,
    round(1 - (feature_bits + map_bits) / ((tokens + 1) * 64), 9) AS rate_saving FROM ({GROUPING})"""
)
def grouping_bitrate(spark, sf_dir):
    c = F.col
    row = rate.grouping_row(c("kept"), c("tokens"), c("feature_bits"), c("map_bits"), F.lit(8), (c("tokens") + 1) * 64, strict=False)  # of one token none is kept here
    return _grouping(spark, sf_dir).select("p_partkey", *[F.round(v, 9).alias(k) for k, v in row.items()])


@query(f"SELECT kept AS kept, CAST(max(feature_bits // (kept + 1)) AS BIGINT) AS token_bits, round(avg(feature_bits), 6) AS mean_bits FROM ({GROUPING}) GROUP BY kept")
def grouping_summary(spark, sf_dir):
    return _grouping(spark, sf_dir).groupBy("kept").agg(F.max(rate.bits_per_token(F.col("feature_bits"), F.col("kept"))).alias("token_bits"), F.round(F.avg("feature_bits"), 6).alias("mean_bits"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(strlen(props)) AS BIGINT) AS total_bytes, round(sum(strlen(props)) * 8 / (count(*) / 30.0::DOUBLE) / 1000, 6) AS kbps FROM events GROUP BY 1")
def video_kbps(spark, sf_dir):
    size = F.sum(F.octet_length("props"))
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(size.alias("total_bytes"), F.round(rate.kilobits_per_second(size, F.count("*")), 6).alias("kbps"))


@query("SELECT event_type, round(sum(strlen(props)) * 8 / (64 * 32 * count(*))::DOUBLE, 9) AS bpp FROM events GROUP BY 1")
def video_bpp(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(rate.bits_per_pixel(F.sum(F.octet_length("props")) * 8, F.lit(64) * F.lit(32), F.count("*")), 9).alias("bpp"))


@query("SELECT p_type, round(avg(0.5 * p_size + p_retailprice / 1000 + p_retailprice / 2000), 6) AS loss FROM part GROUP BY 1")
def rate_distortion_loss(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.round(F.avg(rate.rate_distortion_loss(c("p_size"), c("p_retailprice") / 1000, c("p_retailprice") / 2000, 0.5)), 6).alias("loss"))


@query(
    """SELECT q, count(*) AS n, round(max(q / (255 / (0.08 - 0.01)::DOUBLE) + 0.01), 9) AS value FROM
    (SELECT CAST(floor((greatest(0.01::DOUBLE, least(0.08::DOUBLE, l_discount)) - 0.01::DOUBLE) * (255 / (0.08 - 0.01)::DOUBLE)) AS INTEGER) AS q FROM lineitem) GROUP BY q"""
)
def truncate_quantize_dequantize(spark, sf_dir):
    level = quantise.uniform(quantise.truncate(F.col("l_discount"), 0.01, 0.08), 0.01, 0.08, 8)
    return table(spark, sf_dir, "lineitem").groupBy(level.alias("q")).agg(F.count("*").alias("n"), F.round(F.max(quantise.uniform_inverse(level, 0.01, 0.08, 8)), 9).alias("value"))


@query("SELECT l_returnflag, round(avg((l_quantity - 1) * (1023 / 49.0::DOUBLE)), 6) AS mean_level FROM lineitem GROUP BY 1")
def affine_levels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(quantise.affine(F.col("l_quantity"), 1, 50, 10)), 6).alias("mean_level"))


@query(
    """SELECT q, count(*) AS n, max(list_extract([2.0::DOUBLE, 5, 10, 20, 40], q + 1)) AS value FROM
    (SELECT CAST(greatest(0, least(4, length(list_filter([2.0::DOUBLE, 5, 10, 20, 40], lambda p: p <= l_quantity)) - 1)) AS INTEGER) AS q FROM lineitem) GROUP BY q"""
)
def nonlinear_quantize(spark, sf_dir):
    points = (2, 5, 10, 20, 40)
    q = quantise.nonlinear(F.col("l_quantity"), points)
    return table(spark, sf_dir, "lineitem").select(q.alias("q")).groupBy("q").agg(F.count("*").alias("n"), F.max(quantise.nonlinear_inverse(F.col("q"), points)).alias("value"))


@query(
    """SELECT label, CAST(sum(i) AS BIGINT) AS token_places, CAST(sum(c * 50 + t) AS BIGINT) AS channel_places FROM
    (SELECT label, vec_id % 50 AS t, c, (vec_id % 50) * 64 + c AS i FROM (SELECT label, vec_id, unnest(range(64)) AS c FROM embeddings)) GROUP BY label"""
)
def packing_places(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.pmod("vec_id", F.lit(50)).alias("t"), F.posexplode("embedding").alias("c", "x"))
    place = lambda layout: F.sum(quantise.packed_index(F.col("t"), F.col("c"), 50, 64, layout))
    return rows.groupBy("label").agg(place("token").alias("token_places"), place("channel").alias("channel_places"))


@query(
    """WITH t AS (SELECT DISTINCT p_size::BIGINT AS x FROM part), r AS (SELECT x, x // 8 AS q8, length(bin(x + 2)) AS eg FROM t)
    SELECT x, repeat('1', x::INTEGER) || '0' AS unary_code, lpad(bin(x), 8, '0') AS fixed_code,
    CASE WHEN x < 64 - 51 THEN lpad(bin(x), 5, '0') ELSE lpad(bin(x + 13), 6, '0') END AS truncated_code,
    repeat('1', q8::INTEGER) || '0' || lpad(bin(x - q8 * 8), 3, '0') AS rice_code, repeat('0', (eg - 2)::INTEGER) || bin(x + 2) AS golomb_code,
    repeat('0', (length(bin((CASE WHEN x < 25 THEN 2 * (25 - x) - 1 ELSE 2 * (x - 25) END) + 1)) - 1)::INTEGER) || bin((CASE WHEN x < 25 THEN 2 * (25 - x) - 1 ELSE 2 * (x - 25) END) + 1) AS signed_code FROM r"""
)
def code_strings(spark, sf_dir):
    x = F.col("x")
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("x")).distinct().select(
        "x", codes.unary(x).alias("unary_code"), codes.fixed_length(x, 8).alias("fixed_code"), codes.truncated_binary(x, 51).alias("truncated_code"), codes.rice(x, 3).alias("rice_code"),
        codes.exp_golomb(x, 1).alias("golomb_code"), codes.signed_exp_golomb(x - 25).alias("signed_code"),
    )


@query(
    """SELECT size, count(*) AS n, max(code) AS largest FROM (SELECT CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 ELSE 4 END AS size,
    CASE WHEN v < 128 THEN lpad(lower(hex(v)), 2, '0') WHEN v < 16384 THEN lpad(lower(hex(v + 32768)), 4, '0') ELSE lpad(lower(hex(v + 3221225472)), 8, '0') END AS code
    FROM (SELECT CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS v FROM lineitem)) GROUP BY size"""
)
def varint_codes(spark, sf_dir):
    v = F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("long")
    return table(spark, sf_dir, "lineitem").select(v.alias("v")).groupBy(codes.varint_size(F.col("v")).alias("size")).agg(F.count("*").alias("n"), F.max(codes.varint_hex(F.col("v"))).alias("largest"))


def _active_days(spark, sf_dir):
    day = F.dayofmonth("ts") - 1
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_set(day)).alias("indices")).withColumn("universe", F.lit(31))


@query(
    """SELECT user_id, event_type, n, CASE WHEN ceil(n * 5 / 8) < 4 THEN 'index' ELSE 'bitmap' END AS coding, CAST(13 + least(4, ceil(n * 5 / 8)) AS BIGINT) AS stream_bytes FROM
    (SELECT user_id, event_type, CAST(count(DISTINCT day(ts)) AS INTEGER) AS n FROM events GROUP BY ALL)"""
)
def index_set_size(spark, sf_dir):
    n, u = F.size("indices"), F.col("universe")
    coding = codes.index_coding(n, u)
    payload = F.when(coding == "index", codes.index_payload_size(n, u)).otherwise(codes.bitmap_payload_size(u))
    return _active_days(spark, sf_dir).select("user_id", "event_type", n.alias("n"), coding.alias("coding"), (13 + payload).alias("stream_bytes"))


@query(
    """WITH d AS (SELECT user_id, event_type, list_sort(list(DISTINCT day(ts) - 1)) AS days FROM events GROUP BY ALL),
    s AS (SELECT *, CASE WHEN ceil(length(days) * 5 / 8) < 4 THEN 1 ELSE 0 END AS kind FROM d),
    b AS (SELECT *, CASE WHEN kind = 1 THEN rpad(list_aggregate(list_transform(days, lambda x: lpad(bin(x), 5, '0')), 'string_agg', ''), (ceil(length(days) * 5 / 8) * 8)::INTEGER, '0') END AS bits,
      list_sum(list_transform(days, lambda x: 1::BIGINT << x::BIGINT))::BIGINT AS m FROM s)
    SELECT user_id, event_type, '42495331' || lpad(lower(hex(kind)), 2, '0') || '0000001f' || lpad(lower(hex(length(days))), 8, '0') || CASE WHEN kind = 1
      THEN list_aggregate(list_transform(range(length(bits) // 4), lambda k: lower(hex(('0b' || substr(bits, (4 * k + 1)::INTEGER, 4))::INTEGER))), 'string_agg', '')
      ELSE lpad(lower(hex(m & 255)), 2, '0') || lpad(lower(hex((m >> 8) & 255)), 2, '0') || lpad(lower(hex((m >> 16) & 255)), 2, '0') || lpad(lower(hex((m >> 24) & 255)), 2, '0') END AS stream, TRUE AS round_trip FROM b"""
)
def index_set_bytes(spark, sf_dir):
    coded = _active_days(spark, sf_dir).withColumn("stream", indexset.encode_column("indices", "universe"))
    return coded.select("user_id", "event_type", F.lower(F.hex("stream")).alias("stream"), (indexset.decode_column("stream") == F.col("indices")).alias("round_trip"))
