import random
from collections import defaultdict

import pytest

from tessera.llm import packing, tokens

from . import plain

SCHEMA = "doc_id long, text string, piece string"


def encoded(text):
    encoder = tokens.WordEncoder(open(tokens.vocabulary_path(), encoding="utf-8").read())
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, length):
    """Every piece once, of its document's ids, gapless in its sequence."""
    want = []
    for doc, text in docs:
        ids = encoded(text)
        want += [(doc, k, s, len(ids[s : s + length]), plain.crc(ids[s : s + length])) for k, s in enumerate(range(0, len(ids), length))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


def test_documents(spark):
    texts = [None, "", "one two three", "one two three", "word " * 9000, "longer text. " * 700, " \n", "x" * 300]
    docs = [(k, t) for k, t in enumerate(texts)] + [(2, "one two three"), (None, "no id")]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], SCHEMA)
    check(packing.pack(frame).collect(), docs, packing.LENGTH)
    check(packing.pack(frame, length=64, open_bins=2, pieces_per_task=5).collect(), docs, 64)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_best_fit_takes_the_fullest_that_fits():
    p = packing.BestFit(10, 3)
    assert [p.place(n) for n in (6, 5, 7)] == [(0, 0), (1, 0), (2, 0)]
    assert p.place(4) == (0, 6)  # free: 5, 3 after bin 0 is full
    assert p.place(3) == (2, 7)
    assert p.place(5) == (1, 5)


def test_best_fit_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [p.place(n)[0] for n in (9, 8)] == [0, 1]
    assert p.place(5)[0] == 2  # bin 0, with 1 free, closed
    assert p.place(1)[0] == 1
    with pytest.raises(ValueError):
        p.place(11)


def test_few_sequences():
    rng = random.Random(1)
    sizes = [min(4096, int(rng.lognormvariate(6.5, 1))) + 1 for _ in range(5000)]
    sizes = [min(s, 4096) for s in sizes]
    p = packing.BestFit()
    for s in sizes:
        p.place(s)
    assert p.made <= 1.02 * (sum(sizes) / 4096) + 1
