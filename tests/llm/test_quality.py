import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import quality

from . import plain

REPEATED = "one two three four five six " * 3
DOCS = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, REPEATED, "en"), (5, "a b c d e f g h i j k l m n", "de"), (6, "# * $ % & | < >\nx\n\nx\n x\nx", "en"), (7, "Grüße 你好 naïve " * 4, "de"), (None, "no id " * 10, "en"),
    (8, "a b c d e " * 2000 + "end", "fr"), (8, "a b c d e " * 2000 + "end", "fr"), (9, "the of and to a in is it that was for on he said so we go there now", "en"), (10, "w\x0bx\x0cy\rz 1 2 3 4 5 6 7 8", "en"), (11, "a a a a a a a a a a a a", "en"),
]


def rows(spark, docs):
    frame = spark.createDataFrame([(a, b, c, 1) for a, b, c in docs], "doc_id long, text string, lang string, kept int")
    return quality.judge(frame).collect()


def test_base_columns(spark):
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows(spark, DOCS))
    assert got == sorted(str((d, *plain.quality(t))) for d, t, _ in DOCS)


def test_random_texts(spark):
    texts: list[str] = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.sampled_from(["a", "b", "c", " ", " ", "\n", "\t", "#", "é", "Zz"]), max_size=60).map("".join))
    def collect(t):
        texts.append(t)

    collect()
    got = {r.doc_id: r for r in rows(spark, [(k, t, "en") for k, t in enumerate(texts)])}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality(t), t


def test_distance(spark):
    def plain_distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        half = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda a: sum(x * math.log2(x / m) for x, m in zip(a, half) if x)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    cases = [([1, 0, 3], [2, 2, 2]), ([5, 0, 0], [0, 5, 0]), ([1, 2, 3], [2, 4, 6])]
    frame = spark.createDataFrame(cases, "p array<long>, q array<long>")
    for (p, q), r in zip(cases, frame.select(quality.distance(F.col("p"), F.col("q")).alias("d")).collect()):
        assert abs(r.d - plain_distance(p, q)) < 1e-7
    assert spark.createDataFrame([([0, 0], [1, 1])], "p array<long>, q array<long>").select(quality.distance(F.col("p"), F.col("q")).alias("d")).first().d is None


def test_histograms(spark):
    text = "The the OF und, 12 ab# é!\n x"
    frame = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    r = quality.features(frame).first()
    kinds = Counter("lower" if c.isascii() and c.islower() else "upper" if c.isascii() and c.isupper() else "digit" if c.isdigit() else "space" if c in " \n" else "symbol" if c in quality.SYMBOLS else "punctuation" if c.isascii() else "other" for c in text)
    assert r.classes == [kinds[c] for c in quality.CLASSES]
    common = Counter(w.lower() for w in plain.words(text) if w.lower() in quality.WORDS)
    assert r.common == [common[w] for w in quality.WORDS] + [len(plain.words(text)) - sum(common.values())]


def test_junk_goes_and_prose_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prose = docs.where("lang = 'en'").first().text
    junk = " ".join(w + "%%&$#"[k % 3 :] for k, w in enumerate(dict.fromkeys(prose.split())))
    frame = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6, junk, "en")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality.judge(frame).collect()}
    assert not got[10**6].kept and not got[10**6].base_failed
    good = [r for r in got.values() if not r.base_failed]
    assert sum(r.kept for r in good) > 0.85 * len(good)


def test_empty(spark):
    assert rows(spark, []) == []


def test_no_python(spark, sf):
    plan = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
