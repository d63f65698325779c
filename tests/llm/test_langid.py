import numpy as np
import zlib

from tessera.llm import langid


def test_gradients_are_right():
    rng = np.random.default_rng(3)
    p = {"e": rng.normal(0, 1, (256, langid.EMBEDDING)), "b": rng.normal(0, 0.1, 24), "c": np.zeros(3), "u": rng.normal(0, 1, (24, 3))}
    for k, w in enumerate(langid.WIDTHS):
        p[f"f{k}"] = rng.normal(0, 0.5, (w, langid.EMBEDDING, langid.FILTERS))
    x, y, weight = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones(4)

    def loss(p):
        net = langid.ByteNet(["a", "b", "c"], p["e"], [p["f0"], p["f1"], p["f2"]], p["b"], p["u"], p["c"])
        return -np.log(net.probabilities(x)[np.arange(4), y]).mean()

    grads = langid._gradients(p, x, y, weight)
    for name in ("u", "c", "b", "f0", "f2", "e"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        values = []
        for step in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            values.append(loss(q))
        assert abs((values[0] - values[1]) / 2e-3 - grads[name][at]) < 0.05 * abs(grads[name][at]) + 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_documents(spark):
    texts = [None, "", "12345 !?", "  ", "½²", "the house and the garden " * 40, "das haus und der garten " * 40, "ж" * 5000, "a"]
    docs = spark.createDataFrame([(k, t, ("en", "de")[k % 2] if t and "garden" in t or t and "garten" in t else None, 1) for k, t in enumerate(texts)] + [(5, texts[5], "en", 1)], "doc_id long, text string, lang string, score int")
    train = spark.createDataFrame([(4 * k, f"the house and the garden number {k}", "en") for k in range(30)] + [(4 * k + 1, f"das haus und der garten nummer {k}", "de") for k in range(30)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in range(5))
    assert out[5].lang_pred == "en" and out[6].lang_pred == "de" and out[7].lang_pred in ("en", "de")
    assert {r.doc_id for r in langid.keep(docs, model).collect()} >= {5, 6}
    assert langid.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(train.limit(0))).collect()} == {"und"}


def test_windows_cover_whole_texts():
    texts = [b"x" * n for n in (0, 1, 511, 512, 513, 5000)]
    x, owner, size = langid.windows(texts)
    assert [int(size[owner == k].sum()) for k in range(6)] == [len(t) for t in texts] and x.shape[1] == langid.WINDOW


def test_batches_do_not_matter():
    rng = np.random.default_rng(0)
    net = langid.train([b"the house " * 30, b"das haus " * 30], ["en", "de"], 3)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (10, 600, 3000, 70000)]
    assert net.predict(texts)[0] == [net.predict([t])[0][0] for t in texts]
    assert np.allclose(net.predict(texts)[1], [net.predict([t])[1][0] for t in texts], atol=1e-5)
