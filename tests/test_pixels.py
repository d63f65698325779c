import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels
from tessera.operators import distribution, entropy, metrics, vq
from tessera.plans import report
from tessera.sources import png


def frame(spark, images):
    rows = [(k, ([float(v) for v in x.ravel()], *x.shape)) for k, x in enumerate(images)]
    return spark.createDataFrame(rows, f"id long, image struct<{pixels.IMAGE.replace(' ', ': ').replace(',:', ',')}>")


def arrays(rows):
    return [np.array(r.x["values"]).reshape(r.x.h, r.x.w, r.x.c) for r in rows]


def test_shapes_and_values(spark):
    images = [np.arange(3 * 5 * 2, dtype=float).reshape(3, 5, 2), np.ones((4, 8, 2))]
    df = frame(spark, images)
    run = lambda column: arrays(df.orderBy("id").select(column.alias("x")).collect())
    out = run(pixels.padded_to_multiple(F.col("image"), 4, 9.0))
    assert out[0].shape == (4, 8, 2) and np.array_equal(out[0][0:3, 1:6], images[0]) and out[0][3, 0, 0] == 9 and np.array_equal(out[1], images[1])
    back = df.select("id", pixels.padded_to_multiple(F.col("image"), 4).alias("image")).where("id = 0").select(pixels.roi(F.col("image"), F.lit(0), F.lit(1), F.lit(3), F.lit(5)).alias("x")).collect()
    assert np.array_equal(arrays(back)[0], images[0])
    assert run(pixels.centre_cropped(F.col("image"), 1, 3))[0].tolist() == images[0][1:2, 1:4].tolist()
    assert np.array_equal(run(pixels.resized(F.col("image"), 3, 5))[0], images[0]) and run(pixels.resized(F.col("image"), 6, 10, labels=True))[0][0, 1, 0] == 0
    assert np.allclose(run(pixels.resized(F.col("image"), 2, 2))[1], 1)
    assert np.allclose(run(pixels.normalised(F.col("image"), (1.0, 2.0), (2.0, 4.0)))[0], (images[0] - [1, 2]) / [2, 4])
    first = df.orderBy("id").select(pixels.channels_first(F.col("image")).alias("x")).first().x
    assert first == images[0].transpose(2, 0, 1).ravel().tolist()
    assert df.select(pixels.mse(F.col("image"), F.col("image")).alias("m")).first().m == 0


def test_random_transforms_repeat(spark):
    df = frame(spark, [np.arange(6 * 6 * 1, dtype=float).reshape(6, 6, 1) for _ in range(12)])
    for column in (pixels.flipped(F.col("image"), F.col("id"), 3), pixels.random_cropped(F.col("image"), 3, 3, F.col("id"), 3), pixels.random_scaled(F.col("image"), 0.5, 2, F.col("id"), 3), pixels.distorted(F.col("image"), F.col("id"), 3)):
        a, b = (sorted(map(str, df.repartition(n).select("id", column.alias("x")).collect())) for n in (1, 5))
        assert a == b and len({r.split("id=")[1].split(",", 1)[1] for r in a}) > 1


@pytest.mark.parametrize("c", [1, 2, 3, 4])
def test_png(spark, tmp_path, c):
    x = np.random.default_rng(c).integers(0, 256, (5, 7, c)).astype(np.uint8)
    assert np.array_equal(png.decode(png.encode(x)), x)
    (tmp_path / "seq").mkdir()
    for k in range(2):
        (tmp_path / "seq" / f"{k}.png").write_bytes(png.encode(x))
    got = png.frames(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == [0, 1] and got[0].sequence == "seq" and np.allclose(np.array(got[1].image["values"]).reshape(5, 7, c), x / 255)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (5, 4, 3)).astype(int)
    lines, above = [], np.zeros((4, 3), int)
    for y in range(5):
        left = np.concatenate([np.zeros((1, 3), int), x[y, :-1]])
        corner = np.concatenate([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = (0 * left, left, above, (left + above) // 2, paeth)[y]
        lines.append(bytes([y]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes())
        above = x[y]
    body = zlib.compress(b"".join(lines))
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
    assert np.array_equal(png.decode(data), x)
    with pytest.raises(ValueError):
        png.decode(data[:40] + b"x" + data[41:])
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


def test_frechet(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (4000, 3)), rng.normal(0, 2, (4000, 3)) + [3, 0, 0]
    frame = lambda x: spark.createDataFrame([([float(v) for v in row],) for row in x], "vec array<double>")
    assert abs(distribution.feature_distance(frame(a), frame(a), 3)) < 1e-6
    assert abs(distribution.feature_distance(frame(a), frame(b), 3) - (9 + 3 * 1)) < 1.0
    with pytest.raises(ValueError):
        distribution.feature_distance(frame(a[:1]), frame(b), 3)


def test_priors(spark):
    groups = spark.createDataFrame([(0,), (1,)], "g int")
    pmf = entropy.uniform_pmf(groups, 4)
    assert {r.p for r in pmf.collect()} == {0.25}
    assert [r.cdf for r in entropy.cumulative(pmf).where("g = 0").orderBy("label").collect()] == [0.25, 0.5, 0.75, 1.0]
    mixed = vq.mixed_prior(spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0)], "g int, label int, p double"), 0.5, 2).orderBy("label").collect()
    assert [r.p for r in mixed] == [0.75, 0.25] and mixed[1].rate == 2.0
    assert vq.padded_rows(spark.createDataFrame([([1.0, 2.0, 3.0],)], "vec array<double>"), 2).first().vec == [1, 2, 3, 0]


def test_reports(spark):
    assert report.codec_keys_last(["bpp", "acc", "bpp_z", "miou"]) == ["acc", "miou", "bpp", "bpp_z"]
    text = "first\na,b\n1,2\n3,4\n\nsecond\nc\n5\n"
    assert report.sections(text) == {"first": [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}], "second": [{"c": "5"}]}
    rows = spark.createDataFrame([("m", 0.1, 1.0), ("m", 0.2, 5.0), ("m", 0.1, 3.0)], "k string, rho double, value double")
    assert report.value_ranges(rows, ["k"], [0.1]).first()[:] == ("m", 2, 1.0, 3.0)
    weights = metrics.balanced_weights(spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int"), "label", 3)
    assert {r.label: r.weight for r in weights.collect()} == {0: 4 / 6, 1: 2.0, 2: 0.0}
