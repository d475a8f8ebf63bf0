"""The operators' queries with SQL against DuckDB, and all of them for their columns, on the smallest tables."""

import os

import duckdb
import pytest

from strandline.llm import queries

from ..test_queries import SF, rows

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_document_has_a_row(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert [c for c in COLUMNS[name] if c not in out.columns] == []
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
