"""The registered queries over a whole small table: their columns, one row for each document, and the rows of their SQL."""

import math

import duckdb
import pytest

from lodeseek.llm import registry

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id keep_id group_size kept text_sha256", "op2": "doc_id held_out n_tokens n_known train_tokens base_score score", "op3": "doc_id text n_pseudonyms", "op4": "doc_id text n_lines n_dropped",
    "op5": "doc_id n_shingles component_id kept", "op6": "doc_id n_words n_base first_word last_word base_labels labels score", "op7": "doc_id start n_tokens ids_crc32",
    "op8": "doc_id size source_size target taken", "op9": "doc_id n_tokens ids_sha256 decoded_sha256", "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df = registry.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    ids = con.sql("SELECT doc_id FROM documents").fetchall()
    assert sorted(r.doc_id for r in rows) == sorted(i for (i,) in ids)
    if name in registry.ORACLE_SQL:
        want = con.sql(registry.ORACLE_SQL[name])
        at = [want.columns.index(c) for c in sorted(df.columns)]
        assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
