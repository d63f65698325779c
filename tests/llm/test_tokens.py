import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens

DEFINITION = open(tokens.vocabulary_path(), encoding="utf-8").read()
ENCODER = tokens.WordEncoder(DEFINITION)

ODD = [
    None, "", "   ", "a'll B'S it's 'tis don't. x.y, <|endoftext|> foo<|startoftext|>bar", "ΟΔΟΣ, İstanbul. ﬁne ẞ straße. été", "Éé. a b\x1cc d  \t\r\n x\x0by ..., , . 3rd 42.",
    "<|ENDOFTEXT|>", "a<|EndOfText|>b <|startoftext|>C <|STARTOFTEXT|>", "<|endoftext| > X", "a" * 3000, "ab" * 30 + "&&&&" * 20 + "123", "ÿþß" * 30 + "÷×",
    "½² ß! ​zero‍ 你好。 тест; ТЕСТ! ́lead naïve.", "." * 50 + "word." * 20, "KK Ω ſ", "word" * 5000, "one.\ntwo,\nthree",
]


def whole(text):
    return np.array(ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def test_odd_texts():
    assert list(ENCODER.encode(ODD)) == [whole(t) for t in ODD]
    assert list(ENCODER.encode([])) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aB. ,\n\t'sÉ!é"))), max_size=4))
def test_any_text(texts):
    assert list(ENCODER.encode(texts)) == [whole(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "word", "Été", "x1", "'", " ", "<|", "|>", "endoftext"]), max_size=8).map("".join), max_size=4))
def test_special_tokens(texts):
    assert list(ENCODER.encode(texts)) == [whole(t) for t in texts]


def test_merges_by_rank_then_place():
    merges = tokens.Merges([(1, 2, 5), (5, 5, 6), (2, 2, 7)], 10)
    rows, sizes = merges.apply(np.array([[1, 2, 1, 2, 2, 2, 2], [2, 2, 2, 0, 0, 0, 0], [9, 9, 9, 9, 0, 0, 0]], np.int32), np.array([7, 3, 4]))
    assert [r[:n].tolist() for r, n in zip(rows, sizes)] == [[6, 7, 2], [7, 2], [9, 9, 9, 9]]


def test_small_caches(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 10)
    monkeypatch.setattr(tokens, "CELLS", 8)
    texts = ["some words here", None, "more words there. And more", "some"] * 5
    assert list(tokens.WordEncoder(DEFINITION).encode(texts)) == [whole(t) for t in texts]
