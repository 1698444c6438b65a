"""Every query runs; those with SQL equal DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from veritext.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLE_SQL:
        cur = duck.execute(catalogue.ORACLE_SQL[name])
        assert got == rows([d[0] for d in cur.description], cur.fetchall())
        assert sorted(df.columns) == sorted(d[0] for d in cur.description)


def test_entry_needs_nothing_else(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
