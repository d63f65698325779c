from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate as d

from . import plain

TEXTS = st.lists(st.sampled_from("abcd"), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5), TEXTS, st.integers(1, 6))
def test_automaton(items, text, window):
    named = [(str(k), t) for k, t in enumerate(items)]
    automaton = d.SuffixAutomaton([(n, d.normal_words(t.encode())) for n, t in named], window)
    spans, found = automaton.scan(d.normal_words(text.encode()))
    _, n, hit, n_items, _, _ = plain.decontaminated([(0, text)], named, window)[0]
    assert sum(b - a for a, b in spans) == hit and len(found) == n_items
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


ITEM = "The quick brown fox jumps over the lazy dog and runs away from here"
DOCS = [
    (1, None), (2, ""), (3, "nothing here"), (4, "Before: " + ITEM.upper() + "! After"), (5, "quick brown fox jumps over the lazy dog and runs"), (6, "Größe, zwei-mal; short item"), (None, ITEM), (4, "again " + ITEM),
    (7, "brown fox jumps over the lazy dog and runs"), (8, ("pad " * 3000) + ITEM + " tail" * 3000),
]
ITEMS = [(10, ITEM), (9, ITEM), (10, "x y z"), (11, "zwei mal"), (12, None), (13, "?!"), (None, "nothing here"), (14, "GRÖSSE")]


def test_documents(spark):
    docs = spark.createDataFrame([(a, b, 0, "x") for a, b in DOCS], "doc_id long, text string, n_words int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(plain.decontaminated(DOCS, ITEMS), key=key)
    assert sorted(map(tuple, d.digest(d.matches(docs, items)).collect()), key=key) == want
    assert sorted(map(tuple, d.digest(d.matches(docs, items, block_words=2)).collect()), key=key) == want
    assert d.matches(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert d.matches(docs.limit(0), items).count() == 0


def test_clean(spark):
    docs = spark.createDataFrame([(a, b, len(b or "")) for a, b in DOCS], "doc_id long, text string, n_chars long")
    out = {(r.doc_id, (r.text or "")[:9]): r for r in d.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert (1, "") in out and (2, "") in out and (3, "nothing h") in out
    assert not any(k[0] == 5 for k in out)  # all of it is a passage
    long = out[8, "pad pad p"]
    assert long.text == "pad " * 3000 + " tail" * 3000 and long.n_chars == len(long.text)
    assert out[6, "Größe, ; "[:9]].text == "Größe, ; short item"


def test_blocks_clean_alike(spark):
    docs = spark.createDataFrame([(a, b, len(b or ""), "x") for a, b in DOCS], "doc_id long, text string, n_chars long, items string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda r: tuple(str(x) for x in r)
    assert len(list(d.item_blocks(items, 2))) > 3
    assert sorted(map(tuple, d.clean(docs, items, block_words=2).collect()), key=key) == sorted(map(tuple, d.clean(docs, items).collect()), key=key)


def test_cut_spans():
    assert d.cut_spans("a, B c! d", [1, 3]) == "a, ! d"
    assert d.cut_spans("a b", [0, 2]) == ""
