import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codes, quantise, shapes, text, vectors, wire


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("kind", ["float16", "bfloat16", "float8_e4m3fn", "float8_e5m2"])
def test_wire_types(spark, kind):
    values = [1.0001, -2.0001, 3.14159, 4.125, 0.0, -0.0, 1e-9, 100.0]
    data = wire.to_bytes(np.array(values, np.float32), kind)
    assert len(data) == len(values) * wire.ITEM_BYTES[kind]
    back = wire.from_bytes(data, kind)
    assert np.array_equal(wire.from_bytes(wire.to_bytes(back, kind), kind), back)
    assert np.allclose(back[:4], values[:4], rtol=0.13)
    frame = spark.createDataFrame([(values,), (None,)], "v array<float>")
    rows = frame.select(wire.decode(wire.encode(F.col("v"), kind), kind).alias("b"), wire.bits(F.col("v"), kind).alias("n")).collect()
    assert np.array_equal(np.array(rows[0].b, np.float32), back) and rows[0].n == 8 * len(data) and rows[1].b is None


def test_float8_edges():
    assert wire.from_bytes(wire.to_bytes([448, 449, 464, 465, 1e9], "float8_e4m3fn"), "float8_e4m3fn")[:3].tolist() == [448, 448, 448]
    assert np.isnan(wire.from_bytes(wire.to_bytes([1e9], "float8_e4m3fn"), "float8_e4m3fn"))[0]
    assert np.isinf(wire.from_bytes(wire.to_bytes([1e9, -1e9], "float8_e5m2"), "float8_e5m2")).all()
    assert wire.from_bytes(wire.to_bytes([1.0625, 1.1875], "float8_e4m3fn"), "float8_e4m3fn").tolist() == [1.0, 1.25]  # ties to even


@settings(max_examples=200)
@given(st.lists(st.floats(-1e6, 1e6, width=32), max_size=20))
def test_float16_and_bfloat16_are_nearest(values):
    x = np.array(values, np.float32)
    with np.errstate(over="ignore"):
        assert wire.to_bytes(x, "float16") == x.astype(np.float16).tobytes()
    back = wire.from_bytes(wire.to_bytes(x, "bfloat16"), "bfloat16")
    assert (np.abs(back - x) <= np.abs(x) / 256 + 1e-38).all()


def golomb(x, k):
    digits = bin(x + 2**k)[2:]
    return "0" * (len(digits) - k - 1) + digits


def test_code_strings(spark):
    rows = spark.range(0, 51).select(
        "id", codes.unary(F.col("id")).alias("u"), codes.fixed_length(F.col("id"), 8).alias("f"), codes.truncated_binary(F.col("id"), 51).alias("t"), codes.rice(F.col("id"), 3).alias("r"), codes.rice(F.col("id"), 0).alias("r0"),
        *[codes.exp_golomb(F.col("id"), k).alias(f"g{k}") for k in range(4)], codes.signed_exp_golomb(F.col("id") - 25, 2).alias("s"),
    ).collect()
    for r in rows:
        x = r.id
        assert r.u == "1" * x + "0" and r.f == f"{x:08b}" and r.r == "1" * (x >> 3) + "0" + f"{x & 7:03b}" and r.r0 == r.u
        assert [r.g0, r.g1, r.g2, r.g3] == [golomb(x, k) for k in range(4)]
        assert r.s == golomb(2 * (x - 25) if x >= 25 else 2 * (25 - x) - 1, 2)
    assert len({r.t for r in rows}) == 51 and sum(2.0 ** -len(r.t) for r in rows) == 1.0


def test_varint(spark):
    values = [0, 127, 128, 16383, 16384, 2**30 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", codes.varint_size(F.col("v")).alias("n"), codes.varint_hex(F.col("v")).alias("h")).collect()
    assert [r.n for r in rows] == [1, 1, 2, 2, 4, 4]
    for r in rows:
        first = int(r.h[:2], 16)
        mask = {1: 0x7F, 2: 0x3FFF, 4: 0x3FFFFFFF}[r.n]
        assert int(r.h, 16) & mask == r.v and first >> 6 in {1: (0, 1), 2: (2,), 4: (3,)}[r.n]
    assert one(spark, codes.varint_size(F.lit(2**30))) is None


def test_quantisation(spark):
    x = F.col("id") / 10.0
    rows = spark.range(0, 101).select(x.alias("x"), quantise.uniform(quantise.truncate(x, 2, 8), 2, 8, 4).alias("q"), quantise.nonlinear(x, [5, 1, 9]).alias("n")).collect()
    for r in rows:
        clipped = min(8, max(2, r.x))
        assert abs(r.q - int((clipped - 2) * 15 / 6 + 1e-9)) <= 1
        assert r.n == min(2, max(0, sum(p <= r.x for p in (1, 5, 9)) - 1))
    assert one(spark, quantise.uniform_inverse(F.lit(15), 2, 8, 4)) == 8.0
    assert one(spark, quantise.round_half_even(F.lit(2.5))) == 2.0
    token, channel = quantise.unpacked(quantise.packed_index(F.lit(3), F.lit(5), 7, 9, "channel"), 7, 9, "channel")
    assert (one(spark, token), one(spark, channel)) == (3, 5)
    with pytest.raises(ValueError):
        quantise.packed_index(F.lit(0), F.lit(0), 1, 1, "other")


def test_shapes(spark):
    assert one(spark, F.to_json(shapes.valid_roi(F.lit(3), F.lit(5), F.lit(4), F.lit(8)))) == json.dumps({"top": 0, "left": 1, "height": 3, "width": 5}, separators=(",", ":"))
    assert one(spark, shapes.resize_to_fit(F.lit(5), F.lit(0.5))) == 2 and one(spark, shapes.resize_to_fit(F.lit(1), F.lit(0.1))) == 1
    assert one(spark, shapes.fit_scale(F.lit(10), F.lit(10), 20, 20)) == 1.0
    for length, crop, stride in ((100, 64, 48), (64, 64, 48), (10, 64, 48), (65, 64, 64), (200, 64, 48)):
        starts = one(spark, shapes.crop_starts(F.lit(length), crop, stride))
        assert len(starts) == max(length - crop + stride - 1, 0) // stride + 1
        assert starts == [max(min(k * stride, length - crop), 0) for k in range(len(starts))]
    assert [one(spark, shapes.reduce_zero_label(F.lit(v))) for v in (0, 1, 255)] == [255, 0, 255]


def test_answers(spark):
    options = F.create_map(F.lit("A"), F.lit("a cat."), F.lit("B"), F.lit("a dog"))
    ok = lambda p, a: one(spark, text.answer_is_correct(F.lit(p), F.lit(a), options))
    assert ok("The answer is A", "A") and ok("A. a cat", "A") and ok("B. a dog.", "B")
    assert not ok("", "A") and not ok("B. a dog", "A") and not ok(None, "A") and not ok("a cat", "A")


def test_names(spark):
    names = spark.createDataFrame([("0002_c012_x.jpg",), ("-1_c3.jpg",), ("other.jpg",)], "n string")
    assert [tuple(r.f) for r in names.select(text.reid_fields(F.col("n")).alias("f")).collect()] == [(2, 12), (-1, 3), (None, None)]
    assert one(spark, text.sample_stem(F.lit("train/a/b.c.png"))) == "a__b.c" and one(spark, text.name_prefix(F.lit("seq1_f2.png"))) == "seq1"
    prompt = one(spark, text.prompt(F.lit("Hint: x\nWhich?\n Hint: y"), F.create_map(F.lit("B"), F.lit("b"), F.lit("A"), F.lit("a")), "End"))
    assert prompt == "Which?\nA. a\nB. b\nEnd"


def test_vectors(spark):
    a, b = F.array(*map(F.lit, (3.0, 4.0))), F.array(*map(F.lit, (0.0, 0.0)))
    assert one(spark, vectors.squared_distance(a, b)) == 25 and one(spark, vectors.l2_normalise(a)) == [0.6, 0.8] and one(spark, vectors.l2_normalise(b)) == [0.0, 0.0]
    assert abs(sum(one(spark, vectors.softmax(a))) - 1) < 1e-12
    assert one(spark, vectors.slices(F.array(*map(F.lit, range(4))), 2, 2)) == [[0, 1], [2, 3]]
