"""The registered queries keep their contracts on the smallest tables."""

import duckdb
import pytest

from veritext.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op2_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_quality_crf": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_recompression": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op10_html_suffix": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    df = QUERIES[name](spark, SF)
    assert CONTRACT.get(name, {}).items() <= dict(df.dtypes).items()
    source = "pages" if name.startswith(("op2_", "op10_")) else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    df = QUERIES[name](spark, SF).select(*names)
    assert sorted(repr(tuple(r)) for r in df.collect()) == want
