import random

import numpy as np
import pytest

from tessera.llm import ngram_join
from tessera.llm.common import scratch
from tessera.llm.components import connected_components

from . import plain


def corpus(seed, families=6):
    """Families of near copies at all distances, chains, texts that share a passage, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for f in range(families):
        base = rng.choices(vocabulary, k=rng.choice((8, 30, 120, 300)))
        texts.append(base)
        chain = base
        for _ in range(rng.randrange(1, 25)):
            source = chain if rng.random() < 0.5 else base
            copy = list(source)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            chain = copy
            texts.append(copy)
    for k in range(60):
        own = rng.choices(vocabulary, k=rng.choice((5, 15, 30, 100)))
        texts.append(own + passage if k % 2 else own)
    out = [" ".join(t) for t in texts] + ["a b c", "A B c", "a b", "a", "", None, " \n", "é É"]
    ids = list(range(0, 3 * len(out), 3))
    rng.shuffle(ids)
    return list(zip(ids, out))


def run(spark, docs):
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, node string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(frame).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    docs = corpus(seed)
    assert run(spark, docs) == plain.joined(docs)


def test_blocks_alone(spark, monkeypatch):
    """Step 2 by itself, with every set its own component, in tiny blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    docs = [(d, t) for d, t in corpus(3) if plain.shingle_set(t)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    order = ngram_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    nodes = ngram_join.prefixes(frame, order).groupBy("node").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc")
    sets = ngram_join.full_sets(frame, nodes, 5)
    columns = ngram_join.prefixes(frame, order).dropDuplicates(["node"]).selectExpr("node", "prefix AS columns")
    links = ngram_join.block_links(sets.join(columns, "node").selectExpr("node", "n", "node AS root", "0L AS part", "columns", "shingles"), scratch(spark, "test"))
    roots = {r.node: r.root for r in connected_components(links).collect()}
    by_node = {r.doc_id: r.node for r in ngram_join.prefixes(frame, order).collect()}
    found, want = {}, {}
    for d, (_, c) in plain.joined(docs).items():
        found.setdefault(roots.get(by_node[d], by_node[d]), set()).add(d)
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_bounds():
    """Linked sets share as many prefix columns as the bounds say, whatever the order."""
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randrange(1, 130)
        m = min(4 * n // 3, n + rng.randrange(0, n // 3 + 1))
        overlap = next(o for o in range(n + 1) if 100 * o >= 75 * (n + m - o) or o == n)
        if 100 * overlap < 75 * (n + m - overlap):
            continue
        common = [("both", k) for k in range(overlap)]
        x, y = common + [("x", k) for k in range(n - overlap)], common + [("y", k) for k in range(m - overlap)]
        worst = rng.choice([lambda e: (e[0] == "both", e), lambda e: (e[0] == "y", e), lambda e: hash((e, n))])
        shared = set(sorted(x, key=worst)[: n - int(ngram_join.rest(n))]) & set(sorted(y, key=worst)[: m - int(ngram_join.rest(m))])
        least = ngram_join.need(n, m, max(ngram_join.rest(n), ngram_join.rest(m)))
        assert len(shared) >= least >= max(ngram_join.row_need(m), 1) and least >= ngram_join.row_need(n)


def test_hot_columns(spark, monkeypatch):
    """One pivot a column and a passage in all texts: what the product leaves open, the blocks must find."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 5)
    rng, passage = random.Random(9), [f"p{k}" for k in range(80)]
    docs = []
    for k in range(70):
        words = passage + [f"w{rng.randrange(12)}" for _ in range(rng.choice((10, 14, 20, 25)))]
        docs.append((k, " ".join(words)))
    assert run(spark, docs) == plain.joined(docs)


def test_order_of_columns_changes_nothing(spark, monkeypatch):
    docs = corpus(4, families=3)
    monkeypatch.setattr(ngram_join, "COMMON", 50)
    assert run(spark, docs) == plain.joined(docs)


@pytest.mark.parametrize("misled", [False, True])
def test_sample_decides_no_result(spark, monkeypatch, misled):
    """Without any sample, and with one whose counts are made up."""
    docs = corpus(5, families=3)
    found = np.unique(np.concatenate([np.array(sorted(s), np.uint64) for s in ngram_join.sets_of(ngram_join.pa.array([t for _, t in docs if t]))]))
    counts = np.random.default_rng(1).integers(1, 1000, len(found)) if misled else np.zeros(0, np.int64)
    monkeypatch.setattr(ngram_join, "order_of", lambda docs, length: ngram_join.Order(found if misled else found[:0], counts))
    assert run(spark, docs) == plain.joined(docs)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{k}" for k in range(40))
    frame = spark.createDataFrame([(4, text), (4, text), (2, text), (None, text), (None, ""), (9, "other words stand here alone")], "doc_id long, text string")
    got = sorted(map(str, map(tuple, ngram_join.components(frame).collect())))
    assert got == sorted(map(str, [(4, 36, 2), (4, 36, 2), (2, 36, 2), (None, 36, 2), (None, 0, None), (9, 1, 9)]))
    kept = sorted(str(r.doc_id) for r in ngram_join.distinct_documents(frame).collect())
    assert kept == ["2", "9", "None"]


def test_null_ids_alone_hold_a_text(spark):
    """A near copy that no row with an id holds links, and is a bridge between two others."""
    words = [f"t{k}" for k in range(200)]
    left, right = [f"x{k}" for k in range(20)] + words[20:], words[:-20] + [f"y{k}" for k in range(20)]
    frame = spark.createDataFrame([(7, " ".join(left)), (None, " ".join(words)), (3, " ".join(right))], "doc_id long, text string")
    assert not ngram_join.components(frame.where("doc_id IS NOT NULL")).where("component_id <> doc_id").count()
    assert [r.component_id for r in ngram_join.components(frame).collect()] == [3, 3, 3]


def test_different_texts_without_or_under_one_id_stay(spark):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    docs = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (3, texts[3] + " end"), (None, texts[2] + " end"), (None, "")]
    kept = ngram_join.distinct_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (3, texts[3] + " end"), (None, "")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_empty(spark):
    assert run(spark, []) == {}


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {k: top(k) for k in parent if k in got} and set(parent) - set(got) <= alone
