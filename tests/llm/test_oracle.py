"""Registered queries with SQL, on the driver's smallest tables."""

import duckdb
import pytest

from sonolith.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
