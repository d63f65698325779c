import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import detection, entropy, geometry, graph, indexset, metrics, neighbours, normalise, rate, relational, retrieval, video, vq
from tessera.plans import catalogue

# Rates


def test_bits_of_strings(spark):
    rows = spark.createDataFrame([(1, "a", 0, bytearray(b"xx")), (1, "a", 1, bytearray(b"yyyy")), (1, "b", 0, None)], "sample_id long, stream string, inner_idx int, payload binary")
    assert {r.stream_key: r.bits for r in rate.container_bits(rows, "unit").collect()} == {"a": 16, "b": 0}
    with pytest.raises(ValueError):
        rate.container_bits(rows, "other")


def test_record_bits(spark):
    bits = spark.createDataFrame([(1, "estimated", 80), (1, "z", 20)], "sample_id long, stream string, bits long")
    sizes = spark.createDataFrame([(1, 10, 10)], "sample_id long, h int, w int")
    r = rate.record_bits_per_pixel(bits, sizes).first()
    assert r.bpp == 1.0 and r.bpp_by_stream == {"estimated": 0.8, "z": 0.2}
    with pytest.raises(PySparkException, match="ori_size"):
        rate.record_bits_per_pixel(bits, spark.createDataFrame([(1, None, 10)], "sample_id long, h int, w int")).collect()


def test_unit_bits_prefer_strings(spark):
    frame = spark.createDataFrame([(8, 3.5, 1), (None, 3.5, 1), (None, None, 1)], "s long, l double, b long")
    assert [r.x for r in frame.select(rate.unit_bits(F.col("s"), F.col("l"), F.col("b")).alias("x")).collect()] == [8, 3.5, 1]
    with pytest.raises(PySparkException, match="coded unit"):
        spark.createDataFrame([(None, None, None)], "s long, l double, b long").select(rate.unit_bits(F.col("s"), F.col("l"), F.col("b"))).collect()


def test_token_bits_must_divide(spark):
    assert spark.range(1).select(rate.bits_per_token(F.lit(90), F.lit(8)).alias("x")).first().x == 10
    with pytest.raises(PySparkException, match="divide"):
        spark.range(1).select(rate.bits_per_token(F.lit(91), F.lit(8))).collect()


# Normalisation


@pytest.mark.parametrize("mode,prefix,side", [("per_image", 0, 64), ("per_token_ln", 0, 512), ("split_cls_patch", 3, 128), ("split_reg_cls_patch", 3, 128)])
def test_normalisation_inverts(spark, mode, prefix, side):
    rng = np.random.default_rng(1)
    rows = [(s, t, [float(x) for x in rng.normal(s, 2, 4)]) for s in range(2) for t in range(8)]
    tokens = spark.createDataFrame(rows, "sample_id long, token_idx int, vec array<double>")
    found = normalise.normalise(tokens, mode, prefix)
    back = {(r.sample_id, r.token_idx): r.vec for r in normalise.inverse(found).collect()}
    assert all(np.allclose(back[s, t], v) for s, t, v in rows)
    assert normalise.side_bits(mode, 1, 8) == side
    if mode != "per_token_ln":
        stats = {(r.sample_id, r.part): r for r in normalise.statistics(tokens, mode, prefix).collect()}
        group = {"per_image": lambda t: 0, "split_cls_patch": lambda t: int(t >= 3), "split_reg_cls_patch": lambda t: int(not 1 <= t < 3)}[mode]
        for (s, part), r in stats.items():
            x = np.concatenate([v for a, t, v in rows if a == s and group(t) == part])
            assert math.isclose(r.mu, x.mean(), abs_tol=1e-9) and math.isclose(r.sigma, math.sqrt(x.var() + 1e-5), rel_tol=1e-9)
        payload = normalise.statistics_bytes(normalise.statistics(tokens, mode, prefix)).first().payload
        assert len(payload) * 8 == side


def test_modes_need_prefixes():
    for mode, prefix in (("split_cls_patch", 0), ("split_reg_cls_patch", 1), ("other", 3)):
        with pytest.raises(ValueError):
            normalise.check(mode, prefix)


# Quantisation


def test_assignment(spark):
    rng = np.random.default_rng(7)
    words, x = rng.normal(0, 1, (4, 2, 4)).transpose(0, 1, 2), rng.normal(0, 1, (30, 16))
    book = vq.codebook_table(spark, words, np.full((4, 2), 0.5))
    parts = vq.grouped(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>"), 4, 4)
    got = {(r.id, r.g): (r.label, r.cost) for r in vq.assign(parts, book).collect()}
    for i in range(30):
        for g in range(4):
            d = ((x[i, 4 * g : 4 * g + 4] - words[g]) ** 2).sum(1)
            assert got[i, g][0] == d.argmin() and math.isclose(got[i, g][1], d.min())
    rated = book.withColumn("rate", F.when(F.col("k") == 0, 0.0).otherwise(1e6))
    assert {r.label for r in vq.assign(parts, rated, rate_weight=1.0).collect()} == {0}


def test_kmeans_and_pmf(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.01, (20, 2)) for c in (0, 5, 9)])
    parts = vq.grouped(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>"), 1, 2)
    start = vq.codebook_table(spark, np.array([[[0.5, 0.5], [4, 4], [8, 8], [99, 99]]], float)).drop("rate")
    words = {r.k: r.vec for r in vq.kmeans(parts, start, 10).collect()}
    assert np.allclose([words[k][0] for k in range(3)], [0, 5, 9], atol=0.1) and words[3] == [99.0, 99.0]
    labels = vq.assign(parts, vq.codebook_table(spark, np.array([[words[k] for k in range(4)]])).drop("rate")).select("g", "label")
    pmf = {r.label: r for r in vq.histogram_pmf(labels, 4).collect()}
    assert math.isclose(sum(r.p for r in pmf.values()), 1) and pmf[3].n == 0 and 0 < pmf[3].p < 1e-8
    r = vq.perplexity(vq.histogram_pmf(labels, 4)).first()
    assert abs(r.perplexity - 3) < 1e-4 and r.dead == 1
    assert math.isclose({r.label: r.p for r in vq.smoothed_prior(labels, 4).collect()}[3], 1 / 64)


def test_rotations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 8)) @ rng.normal(0, 1, (8, 8))
    frame = spark.createDataFrame([([float(v) for v in row],) for row in x], "vec array<double>")
    n, mean, covariance = vq.moments(frame, 8)
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(covariance, np.cov(x.T, bias=True))
    for r in (vq.pca_rotation(covariance, 2), vq.procrustes(rng.normal(0, 1, (8, 8))), vq.cayley(rng.normal(0, 1, (8, 8)))):
        assert np.allclose(r @ r.T, np.eye(8))
    assert math.isclose(np.linalg.det(vq.procrustes(rng.normal(0, 1, (8, 8)))), 1)
    _, _, first = vq.learn_rotation(frame, 2, 4, 1)
    rotation, book, best = vq.learn_rotation(frame, 2, 4, 3)
    assert best <= first and np.allclose(rotation @ rotation.T, np.eye(8)) and book.shape == (2, 4, 4)


def test_artifacts():
    good = {"R": np.eye(8), "codebooks": np.zeros((4, 4, 2)), "pmf": np.full((4, 4), 2.0)}
    assert np.allclose(vq.validate_artifact(good)["pmf"], 0.25)
    with pytest.raises(KeyError, match="pmf"):
        vq.validate_artifact({k: v for k, v in good.items() if k != "pmf"})
    for bad in ({"R": np.eye(7)}, {"pmf": np.zeros((4, 4))}, {"codebooks": np.full((4, 4, 2), np.nan)}, {"pmf": np.full((4, 4), -1.0)}):
        with pytest.raises(ValueError):
            vq.validate_artifact(good | bad)


# Entropy coding

FIRST, SECOND = np.array([0.1, 0.2, 0.3, 0.4], np.float32), np.array([0.4, 0.3, 0.2, 0.1], np.float32)


def test_golden_tables_and_streams():
    a, b = entropy.quantised_cdf(FIRST), entropy.quantised_cdf(SECOND)
    assert a == [0, 6554, 19661, 39321, 65535, 65536] and b == [0, 26214, 45874, 58981, 65535, 65536]
    assert entropy.encode([0, 1, 0], a).hex() == "b80223f9f9000000" and entropy.encode([3, 1, 0], b).hex() == "89f798aa29000000"


def test_tables_in_spark(spark):
    rows = [(0, k, float(p)) for k, p in enumerate(FIRST)] + [(1, k, float(p)) for k, p in enumerate(SECOND)]
    found = entropy.cdf_table(spark.createDataFrame(rows, "g int, label int, p double")).orderBy("g", "label").collect()
    assert [r.cdf for r in found] == [0, 6554, 19661, 39321, 0, 26214, 45874, 58981]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40).filter(lambda p: sum(p) > 1e-6), st.data())
def test_streams_round_trip(pmf, data):
    cdf = entropy.quantised_cdf(pmf)
    assert cdf[-2] == 65535 and all(a < b for a, b in zip(cdf, cdf[1:]))
    symbols = data.draw(st.lists(st.integers(0, len(pmf) - 1), max_size=200))
    stream = entropy.encode(symbols, cdf)
    assert entropy.decode(stream, len(symbols), cdf) == symbols
    with pytest.raises(ValueError):
        entropy.decode(stream + b"\0\0\0\0", len(symbols), cdf)


def test_streams_by_group(spark):
    labels = spark.createDataFrame([(1, 0, n, v) for n, v in enumerate([0, 1, 0])] + [(1, 1, n, v) for n, v in enumerate([3, 1, 0])], "stream_id long, g int, n int, label int")
    pmf = spark.createDataFrame([(0, k, float(p)) for k, p in enumerate(FIRST)] + [(1, k, float(p)) for k, p in enumerate(SECOND)], "g int, label int, p double")
    assert {r.g: bytes(r.payload).hex() for r in entropy.encode_streams(labels, pmf).collect()} == {0: "b80223f9f9000000", 1: "89f798aa29000000"}
    got = entropy.likelihood(labels, pmf).orderBy("g", "n").collect()
    assert np.allclose([r.p for r in got], [0.1, 0.2, 0.1, 0.1, 0.3, 0.4])
    with pytest.raises(PySparkException, match="label"):
        entropy.likelihood(labels.withColumn("label", F.lit(9)), pmf).collect()


def test_gaussian_bits(spark):
    x = spark.range(1).select(entropy.gaussian_bits(F.lit(1.0), 2.0).alias("x")).first().x
    phi = lambda v: 0.5 * (1 + math.erf(v / (2 * math.sqrt(2))))
    assert abs(x + math.log2(phi(1.5) - phi(0.5))) < 1e-5


# Index sets


@settings(max_examples=200)
@given(st.integers(1, 300).flatmap(lambda u: st.tuples(st.just(u), st.sets(st.integers(0, u - 1)))))
def test_index_sets_round_trip(case):
    universe, found = case
    stream = indexset.encode(found, universe)
    indices, back, coding = indexset.decode(stream)
    assert indices == sorted(found) and back == universe
    other = min(indexset.payload_size(c, len(found), universe) for c in indexset.CODINGS)
    assert len(stream) == 13 + other


def test_index_set_choice_and_damage(spark):
    assert indexset.decode(indexset.encode([3], 16))[2] == "index" and indexset.decode(indexset.encode(range(12), 16))[2] == "bitmap"
    assert len(indexset.encode([1, 4, 7], 9)) == 13 + 2
    good = indexset.encode([3], 16)
    damaged = [b"", b"XXXX" + good[4:], good + b"\0", good[:-1], good[:-1] + bytes([good[-1] | 1]), good[:4] + b"\7" + good[5:]]
    for bad in damaged:
        with pytest.raises(ValueError):
            indexset.decode(bad)
    for bad in ([1, 1], [-1], [16]):
        with pytest.raises(ValueError):
            indexset.encode(bad, 16)
    frame = spark.createDataFrame([(bytearray(good),), (bytearray(b"no"),), (None,)], "s binary")
    assert [r.x for r in frame.select(indexset.status_column("s").alias("x")).collect()] == ["ok", "stream cut off", "missing"]
    valid = spark.createDataFrame([([1, 2], 3), ([1, 1], 3), ([3], 3), ([], 0)], "i array<int>, u int").select(indexset.is_valid(F.col("i"), F.col("u")).alias("x"))
    assert [r.x for r in valid.collect()] == [True, False, False, False]


# Graphs


@pytest.mark.parametrize("ratio", [1.0 - rho for rho in (0.0, 0.5, 0.9)])  # a ratio of 0 is refused, see test_parity
def test_propagation(spark, ratio):
    rng = np.random.default_rng(5)
    w = rng.random((2, 4, 17, 17))
    rows = [(b, h, i, j, float(w[b, h, i, j])) for b in range(2) for h in range(4) for i in range(17) for j in range(17)]
    edges = spark.createDataFrame(rows, "graph_id long, head int, src long, dst long, w double")
    got = {(r.graph_id, r.node): r.score for r in graph.propagate(edges, rounds=10).collect()}
    a = w.mean(1)
    a = (a + a.transpose(0, 2, 1)) / 2
    a /= a.sum(2, keepdims=True)
    e = np.eye(17)[0]
    s = np.tile(e, (2, 1))
    for _ in range(10):
        after = 0.1 * e + 0.9 * np.einsum("bij,bi->bj", a, s)
        moved, s = np.abs(after - s).sum(1), after
        if moved.max() < 1e-3:
            break
    assert all(math.isclose(got[b, i], s[b, i], rel_tol=1e-9) for b in range(2) for i in range(17))
    scores = spark.createDataFrame([(b, i, v) for (b, i), v in got.items()], "graph_id long, node long, score double")
    kept = graph.top_tokens(scores, ratio).collect()
    assert len(kept) == 2 * (max(int(16 * ratio), 1) + 1) and {r.node for r in kept} >= {0}
    best = sorted(range(1, 17), key=lambda i: -s[0, i])[: max(int(16 * ratio), 1)]
    assert {r.node for r in kept if r.graph_id == 0} == {0, *best}


# Retrieval


def reid(seed, queries=6, gallery=40, dims=5):
    rng = np.random.default_rng(seed)
    row = lambda n, at: [(at + i, int(rng.integers(4)), int(rng.integers(3)), [float(x) for x in rng.normal(0, 1, dims)]) for i in range(n)]
    return row(queries, 0), row(gallery, 1000)


def pairs_of(spark, q, g):
    side = lambda rows, p: spark.createDataFrame(rows, f"{p}_id long, {p}_pid long, {p}_cam long, {p}_vec array<double>")
    return retrieval.distances(side(q, "q"), side(g, "g"))


def test_cmc_and_map(spark):
    q, g = reid(4)
    aps, firsts = [], []
    for _, pid, cam, v in q:
        order = sorted(g, key=lambda r: (sum((a - b) ** 2 for a, b in zip(v, r[3])), r[0]))
        hits = [r[1] == pid for r in order if not (r[1] == pid and r[2] == cam)]
        if any(hits):
            ranks = [k + 1 for k, h in enumerate(hits) if h]
            aps.append(sum((n + 1) / r for n, r in enumerate(ranks)) / len(ranks))
            firsts.append(ranks[0])
    r = retrieval.cmc_map(pairs_of(spark, q, g)).first()
    assert r.valid_queries == len(aps) and math.isclose(r.map, np.mean(aps)) and math.isclose(r.cmc_5, np.mean([f <= 5 for f in firsts]))
    curve = {x.rank: x.cmc for x in retrieval.cmc_curve(pairs_of(spark, q, g), 8).collect()}
    assert math.isclose(curve[5], r.cmc_5) and len(curve) == 8


def test_query_blocks(spark, monkeypatch):
    q, g = reid(6)
    whole = sorted(map(tuple, retrieval.top_k(pairs_of(spark, q, g), 3).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", 10)
    assert sorted(map(tuple, retrieval.top_k(pairs_of(spark, q, g), 3).collect())) == whole


def test_soft_vote(spark):
    rows = [(1, r, s, c) for r, (s, c) in enumerate([(0.9, 1), (0.8, 2), (0.7, 2), (0.1, 3)], 1)]
    votes = {(r.k, r.label): r.score for r in retrieval.soft_vote(spark.createDataFrame(rows, "q_id long, rank int, sim double, label int"), (1, 3), 0.1).collect()}
    p = np.exp(np.array([0.9, 0.8, 0.7, 0.1]) / 0.1)
    p /= p.sum()
    assert math.isclose(votes[1, 1], p[0]) and math.isclose(votes[3, 2], p[1] + p[2]) and (1, 2) not in votes


def test_multiview(spark):
    images = spark.createDataFrame([(i, p) for i, p in enumerate([7] * 4 + [8] * 3)], "img_id long, pid long")
    got = sorted(map(tuple, retrieval.multiview_groups(images).collect()))
    assert got == [(7, 0, 0, 0), (7, 0, 1, 1), (7, 0, 2, 2), (7, 1, 0, 3), (7, 1, 1, 3), (7, 1, 2, 3), (8, 0, 0, 4), (8, 0, 1, 5), (8, 0, 2, 6)]
    order = spark.createDataFrame(list(enumerate([7, 7, 7, 9, 9, 9])), "img_idx long, pid long")
    r = retrieval.vehicle_groups_are_pure(order).first()
    assert r.most == 1 and r.starts == [0, 3]
    assert retrieval.vehicle_groups_are_pure(spark.createDataFrame(list(enumerate([7, 8, 7])), "img_idx long, pid long")).first().most == 2


def test_rerank_without_blend_keeps_distances(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (12, 3))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(12) for j in range(12)], "i long, j long, d double")
    queries = spark.createDataFrame([(0,), (1,)], "i long")
    got = {(r.i, r.j): r.dist for r in retrieval.rerank(pairs, queries, 4, 2, weight=1.0).collect()}
    scaled = (d / d.max(axis=0)).T
    assert len(got) == 20 and all(math.isclose(got[i, j], scaled[i, j]) for i, j in got)
    mixed = retrieval.rerank(pairs, queries, 4, 2, weight=0.3).collect()
    assert all(0 <= r.dist <= 1 for r in mixed)


def test_reciprocal_pairs_cross_labels(spark, sf):
    """The registered whole-table query against numpy; neighbours of other labels count."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids, label = [r.vec_id for r in rows], {r.vec_id: r.label for r in rows}
    near = []
    for i in range(len(rows)):
        d = ((x - x[i]) ** 2).sum(-1)
        near.append({ids[k] for k in sorted(range(len(rows)), key=lambda k: (d[k], ids[k]))[:7]})
    lists = dict(zip(ids, near))
    want = {(i, j) for i in ids for j in lists[i] if i in lists[j]}
    got = {(r.i, r.j) for r in catalogue.QUERIES["k_reciprocal_neighbors_all"](spark, sf).collect()}
    assert got == want and any(label[i] != label[j] for i, j in got)
    ranked = catalogue.QUERIES["jaccard_rerank_all"](spark, sf).select("i", "j").collect()
    n = sum(i % 4 == 0 for i in ids)
    assert len(ranked) == n * (len(ids) - n) and any(label[r.i] != label[r.j] for r in ranked)


def test_reciprocal_neighbours_of_any_label(spark, tmp_path):
    """The nearest have another label or none: no pair is left out for its label."""
    rng = np.random.default_rng(11)
    x = rng.random((60, 3))
    rows = [(k, [float(v) for v in x[k]], k % 5 or None) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = [set(np.argsort(((x - v) ** 2).sum(-1), kind="stable")[:7].tolist()) for v in x]
    want = {(i, j) for i in range(60) for j in near[i] if i in near[j]}
    assert any(rows[i][2] != rows[j][2] for i, j in want) and any(rows[i][2] is None for i, _ in want)
    assert sorted((r.i, r.j) for r in catalogue.QUERIES["k_reciprocal_neighbors"](spark, str(tmp_path)).collect()) == sorted(want)


def test_reciprocal_neighbours_without_a_distance(spark, tmp_path):
    """Vectors or elements that are missing: a pair without a common element is the furthest, as in the SQL."""
    rng = random.Random(3)
    rows = [(20 + k, [rng.choice([0.0, 0.5, 1.0]), rng.random()], k % 3) for k in range(12)]
    rows += [(100, None, 1), (3, [0.5, None], 2), (101, [None, 0.5], None), (4, [0.5], 1), (5, [], 1), (102, [0.5, 0.1, 0.7], 2), (None, [0.5, 0.5], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = catalogue.QUERIES["k_reciprocal_neighbors"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalogue.ORACLE_SQL["k_reciprocal_neighbors"]).fetchall())


@pytest.mark.parametrize("name", ["k_reciprocal_neighbors", "k_reciprocal_neighbors_all", "jaccard_rerank", "jaccard_rerank_all"])
def test_reranking_of_copies_and_single_vectors(spark, tmp_path, name):
    """Labels of one vector or of copies only have no largest distance to divide by; vectors without a label meet nothing by label."""
    rng = random.Random(3)
    rows = [(k, [1.0, 2.0], 1) for k in range(5)] + [(8, [3.0, 4.0], 2), (9, [5.0, 0.0], None)]
    rows += [(20 + k, [rng.choice([0.0, 0.5, 1.0]), rng.random()], 3) for k in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    text = lambda rows: sorted(str(tuple(r)).replace("-0.0)", "0.0)") for r in rows)  # noqa: E731  (zeros have a sign by the order of sums)
    assert text(df.collect()) == text(con.execute(catalogue.ORACLE_SQL[name]).fetchall())
    assert "Join" not in df._jdf.queryExecution().toString() or name.startswith("k_")  # no join for the pairs of the result


@given(st.lists(st.lists(st.sampled_from([0.0, 0.1, 0.2, 0.3, 1.0, 1e3, 1e3 + 1e-9]), min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 5), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_nearest_by_blocks(rows, k, size):
    """Whatever the blocks, copies and values that differ by rounding alone: the order of sums taken element by element."""
    x = np.array(rows)
    d = np.zeros((len(x), len(x)))
    for c in x.T:
        d += (c[:, None] - c[None, :]) ** 2
    near = neighbours.Nearest(np.ascontiguousarray(x.T), k)
    ids = np.arange(len(x)) * 3
    for a in range(0, len(x), size):
        near.meet(ids[a : a + size], np.ascontiguousarray(x[a : a + size].T))
    got = near.rows(ids).to_pydict()
    with np.errstate(invalid="ignore"):
        scaled = d / d.max(axis=1)[:, None]
    want = [(3 * i, 3 * int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((ids, scaled[i]))[:k])]
    assert list(zip(got["i"], got["j"], got["rank"])) == want
    assert str(got["d"]) == str([float(scaled[i // 3, j // 3]) for i, j, _ in want])


def test_neighbours_over_several_blocks(spark):
    """1,500 vectors of a group and 40 of another, some of them copies, against all pairs; what blocks can't hold goes by all pairs."""
    rng = np.random.default_rng(5)
    rows = [(("a", "b")[k >= 1500], k, [float(v) for v in (rng.random(4) if k % 50 else (1, 2, 3, 4))], k % 4 == 0) for k in range(1540)]
    frame = lambda r: spark.createDataFrame(r, "group string, id long, vec array<double>, query boolean")
    vectors = frame(rows)
    assert neighbours.regular(vectors)
    got = {(r.i, r.j) for r in retrieval.reciprocal_vectors(vectors, 6).collect()}
    assert got == {(r.i, r.j) for r in retrieval.reciprocal(retrieval.scaled(retrieval.group_pairs(vectors)), 6).collect()}
    for odd in ([("a", 0, [0.0] * 4, True)], [("a", 9000, [0.0, None, 0.0, 0.0], True)], [("a", 9000, [0.0], True)], [("a", 9000, [float("inf")] * 4, True)], [("a", 9000, None, True)], [("a", None, [0.0] * 4, True)]):
        assert not neighbours.regular(frame(rows[:9] + odd))
    assert not neighbours.regular(frame([])) and retrieval.reciprocal_vectors(frame([]), 6).count() == 0


def test_queries_are_in_each_others_gallery(spark, tmp_path):
    rows = [(0, [0.0, 0.0], 1), (50, [0.1, 0.0], 1), (3, [5.0, 0.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.q_id, r["rank"]): r.g_id for r in catalogue.QUERIES["retrieval_topk_all"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1): 50, (0, 2): 3, (50, 1): 0, (50, 2): 3}


# Metrics


def test_confusion_and_iou(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.choice([0, 1, 2, 255, -1])) for _ in range(300)]
    frame = spark.createDataFrame(rows, "pred int, gt int")
    hist = np.zeros((5, 5))
    for p, g in rows:
        if 0 <= g < 5:
            hist[g, p] += 1
    matrix = metrics.confusion(frame, "pred", "gt", 5)
    assert {(r.gt, r.pred): r.n for r in matrix.collect()} == {(g, p): hist[g, p] for g in range(5) for p in range(5)}
    union = hist.sum(1) + hist.sum(0) - np.diag(hist)
    iou = np.array([hist[i, i] / union[i] if union[i] else np.nan for i in range(5)])
    assert math.isclose(metrics.mean_iou(matrix).first().miou, np.nanmean(iou))
    assert math.isclose(metrics.mean_iou_percent(matrix).first().miou, 100 * np.nan_to_num(iou).mean())


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "pred double, gt double")
    r = metrics.depth_pooled(none, "pred", "gt", 0, 10).first()
    assert (r.n, r.rmse, r.abs_rel) == (0, 0.0, 0.0)
    assert spark.createDataFrame([], "r array<int>, t int").agg(metrics.top_k_accuracy(5, F.col("r"), F.col("t")).alias("a")).first().a == 0.0
    found = spark.createDataFrame([(False, False)], "p boolean, g boolean").agg(metrics.jaccard(F.col("p"), F.col("g"))["jaccard"].alias("j")).first()
    assert found.j == 1.0


def test_record_mean(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    assert metrics.record_mean(rows, ["x"]).first().x == 1.0
    with pytest.raises(PySparkException, match="missing"):
        metrics.record_mean(rows, ["x"], strict=True).collect()


def test_normal_angles(spark):
    angle = lambda a, b: spark.range(1).select(metrics.normal_angle(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("x")).first().x
    assert math.isclose(angle((1.0, 0.0), (0.0, 2.0)), 90) and math.isclose(angle((1.0, 0.0), (3.0, 0.0)), 0, abs_tol=1e-9) and math.isclose(angle((1.0, 0.0), (-1.0, 0.0)), 180)


def test_average_precision():
    assert detection.average_precision([], [[0, 0, 1, 1]], 0.5) == 0.0
    box, far = [0.0, 0, 10, 10], [50.0, 50, 60, 60]
    assert math.isclose(detection.average_precision([(0.9, box)], [box], 0.5), 1, rel_tol=1e-5)
    twice = detection.average_precision([(0.9, box), (0.8, box)], [box, far], 0.5)
    assert math.isclose(twice, 0.5, rel_tol=1e-5)  # the second goes to a taken box
    assert detection.average_precision([(0.9, far)], [box], 0.5) == 0.0


def test_detection_frames(spark):
    pred = spark.createDataFrame([(1, 1, 0.9, [0.0, 0.0, 10.0, 10.0]), (1, 0, 0.9, [0.0, 0.0, 1.0, 1.0]), (1, 2, 0.3, [0.0, 0.0, 5.0, 5.0])], "image long, cls int, score double, box array<double>")
    gt = spark.createDataFrame([(1, 1, [0.0, 0.0, 10.0, 10.0]), (2, 1, [0.0, 0.0, 3.0, 3.0])], "image long, cls int, box array<double>")
    found = detection.class_average_precision(pred, gt)
    assert {(r.image, r.cls): (round(r.ap, 4), r.has_gt) for r in found.collect()} == {(1, 1): (1.0, True), (1, 2): (0.0, False), (2, 1): (0.0, True)}
    assert {r.image: round(r.map, 4) for r in detection.mean_average_precision(found).collect()} == {1: 1.0, 2: 0.0}


# Geometry, video, joins


def test_ms_ssim_db_beyond_one(spark, tmp_path):
    """A similarity of 1 or more shows in its group's mean, as in the SQL."""
    rows = [("a", 250.0), ("a", 560.21), ("b", 250.0), ("b", 500.0), ("c", 250.0), ("c", None), ("d", None), ("e", float("nan")), ("f", 500.0), ("f", 560.21)]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = {k: str(v) for k, v in con.execute(catalogue.ORACLE_SQL["ms_ssim_db"]).fetchall()}
    got = {r.event_type: str(r.db) for r in catalogue.QUERIES["ms_ssim_db"](spark, str(tmp_path)).collect()}
    assert got == want == {"a": "nan", "b": "inf", "c": "3.0103", "d": "None", "e": "nan", "f": "nan"}


def test_crops_cover_and_fuse(spark):
    images = spark.createDataFrame([(1, 100, 70), (2, 10, 10)], "sample_id long, h int, w int")
    crops = geometry.crop_grid(images, 64, 48).collect()
    assert [(r.crop_idx, r.top, r.left) for r in sorted(crops) if r.sample_id == 1] == [(0, 0, 0), (1, 0, 6), (2, 36, 0), (3, 36, 6)]
    values = spark.createDataFrame([(1, 0, 0, 0, 2.0), (1, 0, 0, 0, 4.0), (1, 0, 0, 1, 3.0)], "sample_id long, y int, x int, cls int, value double")
    fused = geometry.fuse_crops(values)
    assert {r.cls: r.value for r in fused.collect()} == {0: 3.0, 1: 3.0}
    assert geometry.decode_task(fused).first().label == 0


def test_crop_fusion_needs_no_join(spark, tmp_path):
    """Sizes travel with the crops: no table of images in the driver, and images that repeat an id meet their own crops only."""
    spark.createDataFrame([(1, 40), (1, 7), (2, 1), (3, 50)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    df = catalogue.QUERIES["crop_fusion"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(catalogue.ORACLE_SQL["crop_fusion"]).fetchall())
    plan = df._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_video_schedule(spark):
    frames = spark.createDataFrame([(1, i) for i in range(20)], "sequence long, frame_idx long")
    got = {r.frame_idx: r for r in video.schedule(frames, 8, 5, 30).collect()}
    last = None
    for i in range(20):
        intra = i % 8 == 0
        qp = 30 if intra else 30 + (0, 1, 0, 2, 0, 2, 0, 2)[i % 8]
        assert (got[i].kind, got[i].qp, got[i].last_qp, got[i].reset) == ("I" if intra else "P", qp, None if intra else last, not intra and i % 5 == 1)
        last = qp
    assert all(r.kind == ("I" if r.frame_idx == 0 else "P") for r in video.schedule(frames, 0, 0, 30).collect())


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (3, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 2, 20.0, 0), (1, 5, 50.0, 0), (1, 5, 51.0, 1), (2, 10, 1.0, 0)], "k long, t long, v double, n long")
    got = {(r.k, r.t): r.last_v for r in relational.asof(left, right, "k", "t", "v", "n").collect()}
    assert got == {(1, 5): 51.0, (1, 1): None, (2, 9): None, (3, 1): None}


def test_positional(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "i int, x string")
    b = spark.createDataFrame([(0, 1), (1, 2)], "i int, y int")
    assert sorted(map(tuple, relational.positional(a, b, ["i"]).collect())) == [(0, "a", 1), (1, "b", 2)]
    with pytest.raises(PySparkException, match="differ"):
        relational.positional(a, b.where("i = 0"), ["i"]).collect()
