"""Every query with SQL gives what DuckDB gives, and the same kinds of columns."""

import os

import duckdb
import pytest

from lintloom.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def norm(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_parity(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rel = con.sql(ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


#: Nothing in the driver's prose and pages matches these; detector_snippets and the queries of part pages have matches.
WITHOUT_ROWS = {"ast_patterns", "html_tables", "html_metadata"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert (QUERIES[name](spark, DATA).count() > 0) == (name not in WITHOUT_ROWS)


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
