import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import container, probe, tiles
from tessera.sources import joined

PICTURES = st.builds(container.Picture, st.booleans(), st.integers(0, 255), st.binary(max_size=300), st.sampled_from([16, 1080, 20000]), st.sampled_from([16, 1920]), st.integers(0, 3))


@settings(max_examples=150)
@given(st.lists(PICTURES, max_size=12))
def test_sequences_round_trip(pictures):
    data = container.write_sequence(pictures)
    assert list(container.read_sequence(data)) == pictures
    sets = len({(p.height, p.width, p.flags) for p in pictures})
    again = container.write_sequence(pictures + pictures)
    assert len(again) == 2 * len(data) - sum(len(container.put_number(h) + container.put_number(w)) + 3 for h, w, _ in {(p.height, p.width, p.flags) for p in pictures}) and sets <= 12
    for cut in range(1, min(len(data), 12)):
        with pytest.raises(ValueError):
            found = list(container.read_sequence(data[:-cut]))
            if len(found) < len(pictures):
                raise ValueError


@settings(max_examples=200)
@given(st.lists(st.tuples(st.integers(0, 255), st.lists(st.sampled_from([0, 0, 1, 2, 3, 128, 255]), max_size=30).map(bytes), st.one_of(st.none(), st.binary(max_size=20))), max_size=6))
def test_layers_round_trip(layers):
    data = container.write_layers(layers)
    assert container.read_layers(data) == layers
    assert data.count(container.START) == len(layers)


@given(st.integers(0, 2**30 - 1))
def test_numbers(n):
    assert container.get_number(b"x" + container.put_number(n), 1) == (n, 1 + len(container.put_number(n)))


def test_streams_in_spark(spark):
    rows = [(s, i, "I" if i == 0 else "P", 30 + i, bytearray(bytes(i)), 16, 16 if i < 3 else 32) for s in (1, 2) for i in range(5)]
    frames = spark.createDataFrame(rows, "sequence long, frame_idx long, kind string, qp int, payload binary, h int, w int")
    got = sorted(map(tuple, container.pictures(container.sequences(frames)).collect()))
    assert got == sorted((s, i, k, q, len(p), h, w) for s, i, k, q, p, h, w in rows)


def test_tiles(spark):
    rows = spark.range(6 * 4 * 5).select(F.floor(F.col("id") / 20).alias("c"), F.floor(F.pmod("id", F.lit(20)) / 5).alias("y"), F.pmod("id", F.lit(5)).alias("x"))
    r, c = tiles.tiled_place(F.col("c"), F.col("y"), F.col("x"), 4, 5, 3)
    placed = rows.withColumns({"row": r, "col": c})
    back = tiles.untiled_place(F.col("row"), F.col("col"), 4, 5, 3)
    assert placed.where((back[0] != F.col("c")) | (back[1] != F.col("y")) | (back[2] != F.col("x"))).count() == 0
    assert placed.select("row", "col").distinct().count() == 120


def test_planes(spark):
    values = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 10.0), (2, 3.0)], "sample_id long, value double")
    found = tiles.quantised_planes(values, 8)
    errors = found.select(F.abs(tiles.restored(F.col("level"), F.col("low"), F.col("high"), 8) - F.col("value")).alias("e")).collect()
    assert max(r.e for r in errors) < 10 / 255


@pytest.mark.parametrize("symbols", [1, 2, 5, 16, 1000])
def test_packed_indices(spark, symbols):
    rows = [([k % symbols for k in range(n)],) for n in (0, 1, 3, 17)]
    frame = spark.createDataFrame(rows, "labels array<int>")
    packed = frame.withColumn("p", tiles.packed_indices(F.col("labels"), symbols))
    got = packed.select("labels", "p", tiles.unpacked_indices(F.col("p"), F.size("labels"), symbols).alias("back")).collect()
    for r in got:
        assert r.back == r.labels and len(r.p) == -(-len(r.labels) * tiles.index_width(symbols) // 8)


def test_cost_report(spark):
    rows = spark.createDataFrame([("a", "conv", 60), ("a", "add", 10), ("b", "conv", 30)], "module string, operator string, flops long")
    got = {(r.kind, r.name): (r.flops, r.share) for r in tiles.cost_report(rows, 1, 2).collect()}
    assert got == {("module", "a"): (70, 0.7), ("operator", "conv"): (90, 0.9), ("operator", "add"): (10, 0.1)}
    assert tiles.mean_complexity(rows, ["flops"]).first().flops == 100 / 3


def test_probe(spark):
    rows = [([float(k % 2 * 4 + k % 3), 1.0], k % 2) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec array<double>, label int")
    got = probe.logistic_probe(frame, frame, (0.01,), 10).first()
    assert got.accuracy == 100.0
    tries = probe.averaged_tries(lambda t: frame.limit(10 + t), lambda df: df.agg(F.lit(1).alias("k"), F.count("*").cast("double").alias("accuracy")), 3).first()
    assert (tries.accuracy, tries.tries) == (11.0, 3)


def test_joined_sources(spark):
    files = lambda *names: spark.createDataFrame([(n, f"/{n}") for n in names], "stem string, path string")
    got = {r.stem: r for r in joined.multi_task(files("a", "b"), {"seg": files("a", "b"), "edge": files("a")}, required=("seg",)).collect()}
    assert got["b"].edge is None and got["a"].edge == "/a" and len(got) == 2
    named = lambda *names: files(*names).withColumnRenamed("stem", "name")
    assert joined.paired(named("x", "y"), named("y", "z")).first()[:] == ("y", "/y", "/y")
    look = lambda **kv: spark.createDataFrame(list(kv.items()), "k string, v string")
    rows = spark.createDataFrame([("p",), ("q",), ("r",)], "k string")
    assert {r.k: r.v for r in joined.coalesced_lookup(rows, "k", look(p="1"), look(p="2", q="3"), "v").collect()} == {"p": "1", "q": "3"}
    assert joined.feature_sets({"h": named("a", "b"), "z": named("a", "b")}).count() == 2
    with pytest.raises(PySparkException, match="differ"):
        joined.feature_sets({"h": named("a", "b"), "z": named("a")}).collect()
    size = spark.range(1).select(joined.adapted_size(F.lit(30), F.lit(45), 14, True).alias("p"), joined.adapted_size(F.lit(30), F.lit(45), 14, False).alias("r")).first()
    assert size.p[:] == (42, 56, 6, 5) and size.r[:] == (28, 42, 0, 0)
