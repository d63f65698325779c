"""Codecs behind the model boundary, image quality and index sets against plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import image_quality as iq
from tessera.operators import indexset, normalise, vq
from tessera.plans import plan


def artifact(groups=2, words=4, width=3, seed=1):
    rng = np.random.default_rng(seed)
    pmf = rng.random((groups, words)) + 0.1
    return {"rotation": vq.cayley(rng.normal(size=(groups * width,) * 2)), "codebooks": rng.normal(size=(groups, words, width)), "pmf": pmf / pmf.sum(1, keepdims=True)}


@pytest.mark.parametrize("mode, prefix", [("per_image", 0), ("per_token_ln", 0), ("split_cls_patch", 1), ("split_reg_cls_patch", 2)])
@pytest.mark.parametrize("weight", [None, 0.5])
def test_product(spark, mode, prefix, weight):
    """The codec gives what the operators give one after the other."""
    found, rng = artifact(), np.random.default_rng(2)
    tokens = {k: rng.normal(size=(5, 6)) for k in (1, 2)}
    samples = spark.createDataFrame([(k, v.tolist()) for k, v in tokens.items()], "sample_id long, vec array<array<double>>")
    codec = plan.build({"type": "product", **found, "mode": mode, "prefix": prefix, "rate_weight": weight})
    streams = codec.encode(samples)
    got = {r.sample_id: np.array(r.vec) for r in codec.decode(streams).collect()}
    rows = samples.select("sample_id", F.posexplode("vec").alias("token_idx", "vec"))
    normal = normalise.normalise(rows, mode, prefix)
    turned = vq.rotate(normal, found["rotation"])
    book = vq.codebook_table(spark, found["codebooks"], found["pmf"])
    labels = vq.assign(vq.grouped(turned.select("sample_id", "token_idx", "vec"), 2, 3), book, weight)
    back = vq.rotate(vq.reconstruct(labels, book, ["sample_id", "token_idx"]), found["rotation"].T)
    want = normalise.inverse(back.join(normal.drop("vec"), ["sample_id", "token_idx"])).collect()
    assert len(want) == 10
    for r in want:
        assert np.allclose(got[r.sample_id][r.token_idx], r.vec, atol=1e-5)
    assert {r.stream for r in streams.collect()} == {"side", "g0", "g1"}


def test_product_refuses(spark):
    codec = plan.build({"type": "product", **artifact()})
    streams = codec.write(np.ones((4, 6)))
    for wrong in ({"side": streams["side"][:-8]}, {"g0": streams["g0"][:-4]}, {"g1": streams["g1"] + bytes(4)}):
        with pytest.raises(ValueError):
            codec.read(streams | wrong)
    with pytest.raises(ValueError):
        codec.write(np.ones((4, 5)))
    with pytest.raises(ValueError):
        plan.build({"type": "product", **artifact(), "mode": "other"})
    assert codec.read(codec.write(np.zeros((0, 6)))).shape == (0, 6)


def test_nonlinear(spark):
    codec = plan.build({"type": "nonlinear", "points": [1.0, -1.0, 0.0]})
    samples = spark.createDataFrame([(1, [-5.0, -0.5, 0.0, 7.0]), (2, [])], "sample_id long, vec array<double>")
    assert {r.sample_id: r.vec for r in codec.decode(codec.encode(samples)).collect()} == {1: [-1.0, -1.0, 0.0, 1.0], 2: []}


def plain_ms_ssim(a, b):
    """Window by window."""
    window = np.outer(iq.gaussian(), iq.gaussian())
    out = 1.0
    for level, weight in enumerate(iq.WEIGHTS):
        similar, contrast = [], []
        for i in range(a.shape[0] - 10):
            for j in range(a.shape[1] - 10):
                x, y = a[i : i + 11, j : j + 11], b[i : i + 11, j : j + 11]
                mx, my = (window * x).sum(), (window * y).sum()
                vx, vy, xy = (window * (x - mx) ** 2).sum(), (window * (y - my) ** 2).sum(), (window * (x - mx) * (y - my)).sum()
                contrast.append((2 * xy + 9e-4) / (vx + vy + 9e-4))
                similar.append((2 * mx * my + 1e-4) / (mx * mx + my * my + 1e-4) * contrast[-1])
        out *= np.mean(similar if level == 4 else contrast) ** weight
        a, b = (x.reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).mean((1, 3)) if level < 4 else x for x in (a, b))
    return out


def test_ms_ssim():
    rng = np.random.default_rng(3)
    a = rng.random((176, 176))
    b = np.clip(a + rng.normal(size=a.shape) * 0.1, 0, 1)
    assert math.isclose(iq.ms_ssim_of(a, b), plain_ms_ssim(a, b), rel_tol=1e-9)
    assert iq.ms_ssim_of(a, a) == pytest.approx(1)
    assert iq.ms_ssim_of(a[:30, :20], a[:30, :20]) == pytest.approx(1)
    assert 0 <= iq.ms_ssim_of(a, 1 - a) < 0.2
    with pytest.raises(ValueError):
        iq.ms_ssim_of(a, a[:-1])


def test_quality_columns(spark):
    rows = [([0.5] * 16, [0.5] * 16, 4, 4), (None, [0.5] * 16, 4, 4), ([0.5] * 16, [0.5] * 16, None, 4)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, h int, w int")
    assert [r[0] for r in df.select(iq.gmsd("a", "b", "h", "w")).collect()] == [0.0, None, None]
    assert [r[0] for r in df.select(F.round(iq.ms_ssim("a", "b", "h", "w"), 9)).collect()] == [1.0, None, None]


@pytest.mark.parametrize("universe, indices", [(1, []), (1, [0]), (9, [0, 8]), (1000, [3]), (1000, [999, 0, 512]), (70000, [65536, 1]), (64, range(0, 64, 3))])
def test_index_bytes(universe, indices):
    """Against one whole number that holds all bits."""
    found = sorted(indices)
    width = indexset.width_of(universe)
    size, listed = -(-universe // 8), -(-len(found) * width // 8)
    if listed < size:
        whole = 0
        for i in found:
            whole = whole << width | i
        want = (whole << 8 * listed - width * len(found)).to_bytes(listed, "big")
    else:
        want = sum(1 << i for i in found).to_bytes(size, "little")
    stream = indexset.encode(indices, universe)
    assert stream[indexset.HEADER.size :] == want
    assert indexset.decode(stream)[:2] == (found, universe)


def test_learned_rotation_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(x.tolist(),) for x in rng.normal(size=(60, 4))]
    one, two = (vq.learn_rotation(spark.createDataFrame(r, "vec array<double>").repartition(n), 2, 3, 2) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])
