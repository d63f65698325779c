"""Queries of normalisation, vector quantisation and entropy models. The codebook is the mean vector of each label."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import entropy, normalise, rate, vq
from tessera.plans.registry import query, sql_distance, table

G, D, K = 8, 8, 10


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("sample_id"), F.pmod("vec_id", F.lit(50)).alias("token_idx"), F.col("embedding").alias("vec"))


def _stats_sql(part: str) -> str:
    return f"""SELECT vec_id // 50 AS sample_id, CAST({part} AS INTEGER) AS part, round(avg(v::DOUBLE), 9) AS mu, round(sqrt(var_pop(v::DOUBLE) + 1e-5::DOUBLE), 9) AS sigma
    FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY ALL"""


def _stats(spark, sf_dir, mode, prefix=0):
    return normalise.statistics(_tokens(spark, sf_dir), mode, prefix).select("sample_id", "part", F.round("mu", 9).alias("mu"), F.round("sigma", 9).alias("sigma"))


@query(_stats_sql("0"))
def norm_per_image(spark, sf_dir):
    return _stats(spark, sf_dir, "per_image")


@query(_stats_sql("CASE WHEN vec_id % 50 < 5 THEN 0 ELSE 1 END"))
def norm_split_cls_patch(spark, sf_dir):
    return _stats(spark, sf_dir, "split_cls_patch", 5)


@query(_stats_sql("CASE WHEN vec_id % 50 BETWEEN 1 AND 4 THEN 0 ELSE 1 END"))
def norm_split_reg_cls_patch(spark, sf_dir):
    return _stats(spark, sf_dir, "split_reg_cls_patch", 5)


@query("SELECT vec_id, round(avg(v::DOUBLE), 9) AS mu, round(sqrt(var_pop(v::DOUBLE) + 1e-5::DOUBLE), 9) AS sigma FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id")
def norm_per_token(spark, sf_dir):
    found = normalise.normalise(_tokens(spark, sf_dir), "per_token_ln")
    return found.select((F.col("sample_id") * 50 + F.col("token_idx")).alias("vec_id"), F.round("mu", 9).alias("mu"), F.round("sigma", 9).alias("sigma"))


@query("SELECT count(*) AS tokens, 0.0::DOUBLE AS largest_error FROM embeddings")
def norm_inverse(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    back = normalise.inverse(normalise.normalise(tokens, "split_reg_cls_patch", 5)).withColumnRenamed("vec", "back")
    error = F.array_max(F.transform(F.arrays_zip("vec", "back"), lambda s: F.abs(s["vec"].cast("double") - s["back"])))
    return tokens.join(back, ["sample_id", "token_idx"]).agg(F.count("*").alias("tokens"), F.round(F.max(error), 6).alias("largest_error"))


def _codebook(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"))
    return vq.grouped(means, G, D).select("g", F.col("label").cast("int").alias("k"), F.col("part").alias("vec"))


def _parts(spark, sf_dir):
    return vq.grouped(table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec")), G, D)


def _assigned(spark, sf_dir):
    return vq.assign(_parts(spark, sf_dir), _codebook(spark, sf_dir))


BOOK = """book AS (SELECT k, list(m ORDER BY i) AS vec FROM (SELECT label::INTEGER AS k, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY k),
    words AS (SELECT g::INTEGER AS g, k, vec[(g * 8 + 1):(g * 8 + 8)] AS vec FROM book, range(8) t(g)),
    parts AS (SELECT vec_id, g::INTEGER AS g, embedding[(g * 8 + 1):(g * 8 + 8)]::DOUBLE[] AS part FROM embeddings, range(8) t(g))"""


def _assign_sql(book: str, name: str, cost: str = "") -> str:
    return f"""{name} AS (SELECT vec_id, g, part, (best).k AS label, (best).cost AS cost FROM (SELECT vec_id, g, part, min({{'cost': {sql_distance("part", "vec")}{cost}, 'k': k}}) AS best FROM parts JOIN {book} USING (g) GROUP BY ALL))"""


ASSIGNED = f"{BOOK}, {_assign_sql('words', 'found')}"


@query(f"WITH {ASSIGNED} SELECT vec_id, g, label, round(cost, 9) AS cost FROM found")
def pq_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("vec_id", "g", "label", F.round("cost", 9).alias("cost"))


@query(f"WITH {ASSIGNED} SELECT g, round(avg(cost) / 8, 9) AS mse FROM found GROUP BY g")
def pq_recon_mse(spark, sf_dir):
    found = _assigned(spark, sf_dir)
    back = vq.reconstruct(found, _codebook(spark, sf_dir), ["vec_id", "g"]).withColumnRenamed("vec", "word")
    return found.join(back, ["vec_id", "g"]).groupBy("g").agg(F.round(F.avg(V.squared_distance(F.col("part"), F.col("word"))) / D, 9).alias("mse"))


@query(f"WITH {BOOK}, rated AS (SELECT *, -log2((k + 1) / 55.0::DOUBLE) AS rate FROM words), {_assign_sql('rated', 'found', ' + rate / 20')} SELECT g, label, count(*) AS n, round(sum(cost), 6) AS cost FROM found GROUP BY ALL")
def ecvq_assign(spark, sf_dir):
    book = _codebook(spark, sf_dir).withColumn("rate", -F.log2((F.col("k") + 1) / 55))
    return vq.assign(_parts(spark, sf_dir), book, rate_weight=20.0).groupBy("g", "label").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def _lloyd_sql() -> str:
    out = BOOK
    book = "words"
    for r in range(3):
        out += f""", {_assign_sql(book, f"f{r}")}, m{r} AS (SELECT g, label AS k, list(m ORDER BY i) AS after FROM (SELECT g, label, i, avg(x) AS m FROM (SELECT g, label, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM f{r}) GROUP BY ALL) GROUP BY ALL),
        w{r} AS (SELECT b.g, b.k, coalesce(m.after, b.vec) AS vec FROM {book} b LEFT JOIN m{r} m USING (g, k))"""
        book = f"w{r}"
    return out


@query(f"WITH {_lloyd_sql()} SELECT g, k, round(list_sum(vec), 6) AS total, round(vec[1], 6) AS first FROM w2")
def kmeans_3_iters(spark, sf_dir):
    words = vq.kmeans(_parts(spark, sf_dir), _codebook(spark, sf_dir), 3, tolerance=0.0)
    return words.select("g", "k", F.round(V.total(F.col("vec")), 6).alias("total"), F.round(F.col("vec")[0], 6).alias("first"))


PMF = f"""{ASSIGNED}, grid AS (SELECT g::INTEGER AS g, k::INTEGER AS label FROM range(8) a(g), range(10) b(k)),
    counts AS (SELECT g, label, coalesce(n, 0) AS n FROM grid LEFT JOIN (SELECT g, label, count(*) AS n FROM found GROUP BY ALL) USING (g, label)),
    pmf AS (SELECT g, label, n, greatest(n::DOUBLE, 1e-7::DOUBLE) / sum(greatest(n::DOUBLE, 1e-7::DOUBLE)) OVER (PARTITION BY g) AS p FROM counts)"""


def _pmf(spark, sf_dir):
    return vq.histogram_pmf(_assigned(spark, sf_dir).select("g", "label"), K)


@query(f"WITH {PMF} SELECT g, label, CAST(n AS BIGINT) AS n, round(p, 12) AS p FROM pmf")
def pmf_histogram(spark, sf_dir):
    return _pmf(spark, sf_dir).select("g", "label", "n", F.round("p", 12).alias("p"))


@query(f"WITH {PMF} SELECT g, label, round((n + 1) / (sum(n) OVER (PARTITION BY g) + 10)::DOUBLE, 12) AS p FROM counts")
def smoothed_prior(spark, sf_dir):
    return vq.smoothed_prior(_assigned(spark, sf_dir).select("g", "label"), K).select("g", "label", F.round("p", 12).alias("p"))


@query(f"WITH {PMF} SELECT round(avg(e), 9) AS perplexity, CAST(sum(dead) AS BIGINT) AS dead FROM (SELECT g, exp(-sum(p * ln(p + 1e-10::DOUBLE))) AS e, sum((n = 0)::INTEGER) AS dead FROM pmf GROUP BY g)")
def perplexity(spark, sf_dir):
    return vq.perplexity(_pmf(spark, sf_dir)).select(F.round("perplexity", 9).alias("perplexity"), F.col("dead").cast("long").alias("dead"))


@query(
    f"""WITH {PMF}, s AS (SELECT g, label, p / sum(p) OVER (PARTITION BY g) * (65535 - 10) AS s FROM pmf), x AS (SELECT *, floor(s) AS e FROM s),
    r AS (SELECT *, 65525 - sum(e) OVER (PARTITION BY g) AS left_, row_number() OVER (PARTITION BY g ORDER BY round(s - e, 9) DESC, label) AS place FROM x),
    f AS (SELECT g, label, CAST(e + 1 + CASE WHEN place <= left_ THEN 1 ELSE 0 END AS BIGINT) AS freq FROM r)
    SELECT g, label, freq, CAST(coalesce(sum(freq) OVER (PARTITION BY g ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cdf FROM f"""
)
def cdf_quantized(spark, sf_dir):
    return entropy.cdf_table(_pmf(spark, sf_dir).select("g", "label", "p"))


@query(f"WITH {PMF} SELECT g, round(-sum(log2(greatest(p, 1.1754943508222875e-38::DOUBLE))), 6) AS bits FROM found JOIN pmf USING (g, label) GROUP BY g")
def label_likelihood_rate(spark, sf_dir):
    found = entropy.likelihood(_assigned(spark, sf_dir).select("g", "label"), _pmf(spark, sf_dir))
    return found.groupBy("g").agg(F.round(rate.likelihood_bits(F.col("p")), 6).alias("bits"))


@query(f"WITH {PMF} SELECT count(DISTINCT vec_id) AS tokens, round(-sum(log2(p + 1e-30::DOUBLE)) / count(DISTINCT vec_id), 6) AS xent_bpt, round(8 * log2(10.0), 9) AS max_bpt, round((-sum(log2(p + 1e-30::DOUBLE)) / count(DISTINCT vec_id) + 64) / 64, 9) AS bpfp FROM found JOIN pmf USING (g, label)")
def entropy_report(spark, sf_dir):
    labels = _assigned(spark, sf_dir).select("g", "label", F.col("vec_id").alias("token"))
    out = rate.entropy_report(labels, _pmf(spark, sf_dir), K, 64, 64)
    return out.select("tokens", F.round("xent_bpt", 6).alias("xent_bpt"), F.round("max_bpt", 9).alias("max_bpt"), F.round("bpfp", 9).alias("bpfp"))


@query(
    f"""WITH {ASSIGNED}, grid AS (SELECT g::INTEGER AS g, k::INTEGER AS label FROM range(8) a(g), range(10) b(k)),
    train AS (SELECT g, label, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY g) + 10)::DOUBLE AS p FROM grid LEFT JOIN (SELECT g, label, count(*) AS n FROM found WHERE vec_id % 5 <> 0 GROUP BY ALL) USING (g, label)),
    test AS (SELECT vec_id, g, label FROM found WHERE vec_id % 5 = 0), emp AS (SELECT g, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY g) AS p FROM test GROUP BY g, label)
    SELECT (SELECT round(-sum(log2(p + 1e-30::DOUBLE)) / count(DISTINCT vec_id), 6) FROM test JOIN train USING (g, label)) AS xent_bpt, (SELECT round(-sum(p * log2(p)), 6) FROM emp) AS test_entropy_bpt, round(8 * log2(10.0), 9) AS max_bpt"""
)
def offline_dataset_rates(spark, sf_dir):
    found = _assigned(spark, sf_dir).select("vec_id", "g", "label")
    prior = vq.smoothed_prior(found.where("vec_id % 5 <> 0").select("g", "label"), K)
    test = found.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "token")
    cross = rate.entropy_report(test, prior, K, 0, 64).select(F.round("xent_bpt", 6).alias("xent_bpt"), F.round("max_bpt", 9).alias("max_bpt"))
    own = vq.histogram_pmf(test.select("g", "label"), K).where("n > 0").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("test_entropy_bpt"))
    return cross.crossJoin(own).select("xent_bpt", "test_entropy_bpt", "max_bpt")


@query()
def rans_streams(spark, sf_dir):
    labels = _assigned(spark, sf_dir).select(F.floor(F.col("vec_id") / 50).alias("stream_id"), "g", F.col("vec_id").alias("n"), "label")
    return entropy.encode_streams(labels, _pmf(spark, sf_dir)).select("stream_id", "g", F.hex("payload").alias("payload"), F.octet_length("payload").alias("bytes"))


@query("SELECT CAST(floor(vec_id / 50) AS BIGINT) AS stream_id, g::INTEGER AS g, count(*) AS n, TRUE AS round_trip FROM embeddings, range(8) t(g) GROUP BY 1, 2")
def rans_round_trip(spark, sf_dir):
    """Streams written and read back: the labels come out as they went in."""
    labels = _assigned(spark, sf_dir).select(F.floor(F.col("vec_id") / 50).alias("stream_id"), "g", F.col("vec_id").alias("n"), "label")
    pmf = _pmf(spark, sf_dir)
    want = labels.groupBy("stream_id", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"].cast("int")).alias("labels"))
    joined = entropy.encode_streams(labels, pmf).join(want, ["stream_id", "g"])
    return entropy.decode_streams(joined, pmf).select("stream_id", "g", F.size("labels").cast("long").alias("n"), (F.col("labels") == F.col("decoded")).alias("round_trip"))


@query("SELECT label, CAST(sum(length(embedding) * 16) AS BIGINT) AS bits, CAST(sum(length(embedding) * 16) AS BIGINT) AS payload_bits FROM embeddings GROUP BY label")
def raw_dtype_bits(spark, sf_dir):
    from tessera.functions import wire

    coded = table(spark, sf_dir, "embeddings").select("label", wire.bits(F.col("embedding"), "float16").alias("bits"), wire.encode(F.col("embedding"), "float16").alias("payload"))
    return coded.groupBy("label").agg(F.sum("bits").alias("bits"), F.sum(F.octet_length("payload") * 8).cast("long").alias("payload_bits"))


@query()
def learned_rotation(spark, sf_dir):
    """Mean squared error of rotated product quantisation after a few rounds, beside that of the first rotation."""
    vectors = table(spark, sf_dir, "embeddings").select("embedding")
    _, _, first = vq.learn_rotation(vectors, G, 4, 1, "embedding")
    _, _, best = vq.learn_rotation(vectors, G, 4, 3, "embedding")
    return spark.createDataFrame([(float(first), float(best), bool(best <= first))], "first double, best double, no_worse boolean")


@query("SELECT label, CAST(0 AS BIGINT) AS bits FROM embeddings GROUP BY label")
def bypass_codec(spark, sf_dir):
    from tessera.plans.plan import Bypass

    samples = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "sample_id")
    return Bypass().encode(samples).join(samples.select("sample_id", "label"), "sample_id").groupBy("label").agg(F.sum(F.octet_length("payload") * 8).cast("long").alias("bits"))
