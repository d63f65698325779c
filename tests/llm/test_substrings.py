import random

import pytest

from tessera.llm import substrings

from . import plain


def corpus(seed, docs=40, vocabulary=3):
    rng = random.Random(seed)
    texts = []
    passage = [str(rng.randrange(1000)) for _ in range(30)]
    for k in range(docs):
        w = [str(rng.randrange(vocabulary if k % 3 else 1000)) for _ in range(rng.randrange(60))]
        if k % 4 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(3) :]
        texts.append(" ".join(w))
    texts += [texts[3], texts[4], texts[4], None, "", " \t ", "x " * 500, "x " * 500, "Ä ö\x0bü " * 30]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def run(spark, docs, length, parts=5):
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, key string").repartition(parts)
    return sorted(map(tuple, substrings.dedup(frame, length, with_text=True).collect()), key=str)


@pytest.mark.parametrize("seed,length", [(1, 20), (2, 6), (3, 2), (4, 10)])
def test_brute_force(spark, seed, length):
    docs = corpus(seed)
    assert run(spark, docs, length) == sorted(plain.deduplicated(docs, length), key=str)


def test_small_chunks(spark, monkeypatch):
    docs = corpus(7)
    from tessera.llm import hashing

    assert list(hashing.chunks("abcdefg", lambda _: 1, 3)) == [["a", "b", "c"], ["d", "e", "f"], ["g"]]
    assert run(spark, docs, 8, parts=40) == sorted(plain.deduplicated(docs, 8), key=str)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(map(str, range(30)))
    docs = [(1, text), (1, text), (2, text + " tail"), (None, text), (None, text), (0, None)]
    assert run(spark, docs, 20) == sorted(plain.deduplicated(docs), key=str)


def test_a_copy_under_an_id_with_another_text(spark):
    """Only the copy goes whole; the other text of its id stays, and is the first place of a later document."""
    copied, own = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    docs = [(1, copied), (2, copied), (2, own), (3, own + " tail")]
    removed = sorted((d, n, gone) for d, n, gone, *_ in run(spark, docs, 20))
    assert removed == [(1, 30, 0), (2, 30, 0), (2, 30, 30), (3, 31, 30)]


def test_empty(spark):
    assert run(spark, [], 20) == []


def test_odd_length(spark):
    with pytest.raises(ValueError):
        substrings.dedup(spark.createDataFrame([], "doc_id long, text string"), 7)


def test_levels(spark):
    text = " ".join(map(str, range(100)))
    docs = spark.createDataFrame([(1, text), (2, "other " + text), (3, " ".join(map(str, range(200, 300))))], "doc_id long, text string")
    assert [tuple(r) for r in substrings.levels(docs, 20).collect()] == [(20, 81, 162), (40, 61, 122), (80, 21, 42)]
