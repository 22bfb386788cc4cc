"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from graphloom.plans import catalogue, graph_queries, link_queries, sources, stored_queries  # noqa: F401

D = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    at = [want.columns.index(c) for c in columns]
    assert sorted((rounded(r) for r in df.select(*columns).collect()), key=repr) == sorted((rounded([r[i] for i in at]) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
