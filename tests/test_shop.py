"""Findings in a small shop against what is written by hand, through DuckDB."""

import duckdb
import pytest
import shop


@pytest.mark.parametrize("name", sorted(shop.CASES))
def test_shop(spark, name):
    find, sql = shop.CASES[name]
    df, want = find(spark, None), duckdb.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
