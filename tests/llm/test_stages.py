"""Every pipeline stage and operator on odd tables: nulls in any column, empty and very long texts, repeated rows, no rows, clashing names."""

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, langid, ngram_join, packing, quality, secrets, sstable, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, node int, spans string, first string, start int, key string, kept int, classes string, score string"
PROSE = "the house and the garden were old and the people of the town came to see them every day of the year"
ROWS = [
    (1, PROSE, "en", "s", 99), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "  \n", "en", "s", 3), (5, PROSE, None, "s", None), (1, PROSE, "en", "s", 99), (None, "no id but words enough to stand alone here", "en", "s", 1),
    (6, "das haus und der garten waren alt und die leute der stadt kamen um sie zu sehen an jedem tag " * 400, "de", "s", 5), (7, "12 34 !!", "en", "s", 8), (8, 'key api_key = "abcdef0123456789" ' + PROSE + " again", "en", "s", 9), (9, "ж" * 30000, "ru", None, 1),
]
ITEMS = [(1, "people of the town came to see them every day of the year"), (2, None), (None, "x")]


@pytest.fixture
def odd(spark, tmp_path):
    rows = [(*r, "x", 1, "y", "z", 2, "k", 3, "c", "s") for r in ROWS]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, str(tmp_path)


def test_stages(spark, odd):
    docs, folder = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names, name
        assert out.count() <= docs.count()
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(ROWS)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_decisions(spark, odd):
    docs, folder = odd
    told = {r.doc_id for r in corpus_pipeline.tell_language(spark, docs, folder).collect()}
    assert told >= {1, 5, 6, 8} and not told & {2, 3, 4, 7}
    single = [r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, folder).collect()]
    assert sorted(single, key=str) == sorted([1, 2, 3, 4, 6, 7, 9, None], key=str)  # 5 and 8 are near copies of 1
    clean = {r.doc_id: r.text for r in corpus_pipeline.remove_benchmark(spark, docs, folder).collect()}
    assert 1 not in clean and clean[2] is None and clean[3] == "" and "town" not in clean[8]
    safe = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, folder).collect()}
    assert "abcdef0123456789" not in safe[8].text and safe[8].n_chars == len(safe[8].text) and safe[1].n_chars == 99


def test_operators_take_the_table(spark, odd):
    docs, folder = odd
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    n = len(ROWS)
    assert quality.judge(docs).count() == n
    assert decontaminate.digest(decontaminate.matches(docs, items)).count() == n
    assert secrets.digest(secrets.scan(docs, secrets.fit(docs))).count() == n
    assert substrings.dedup(docs).count() == n
    assert sstable.read(sstable.write(docs)).count() == n
    assert packing.pack(docs).where("piece = 0").count() == n
    assert langid.predict(docs, langid.fit(docs)).count() == n
    assert ngram_join.components(docs).count() == n
