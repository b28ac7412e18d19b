"""Queries with SQL match DuckDB on the smallest tables."""

import duckdb
import pytest

from reelscribe.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.sql(SQL[name])
    columns = sorted(found.columns)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    expected = [tuple(row[found.columns.index(c)] for c in columns) for row in found.fetchall()]
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, expected))
