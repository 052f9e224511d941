"""Queries with SQL against it."""

import os

import duckdb
import pytest

from quarryline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    rows = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, rows)) == sorted(cur.fetchall())
