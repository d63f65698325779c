"""Every query of the subpackage over the smallest data: the contract's columns and a row for each input row."""

import pytest

from tessera.llm.queries import QUERIES

COLUMNS = {
    1: ("pages", ["page_id", "host", "path", "rule", "verdict"]), 2: ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    3: ("pages", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]), 4: ("documents", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
    5: ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]), 6: ("documents", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    7: (None, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]), 8: ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    9: ("documents", ["doc_id", "held_out", "lang_pred", "score"]), 10: ("documents", ["doc_id", "n_shingles", "component_id"]),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    source, columns = COLUMNS[int(name[2:].split("_")[0])]
    out = QUERIES[name](spark, sf)
    assert out.columns[: len(columns)] == columns
    n = out.count()
    assert n == spark.read.parquet(f"{sf}/{source}.parquet").count() if source else n > 0
