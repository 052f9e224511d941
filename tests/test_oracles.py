"""Every query against its SQL on the small tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__

SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}
QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def con(sf_path):
    c = duckdb.connect()
    for name in os.listdir(sf_path):
        t = name.removesuffix(".parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_path}/{name}')")
    return c


@pytest.fixture(scope="module")
def sf_path():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 4) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_path, name):
    df = QUERIES[name](spark, sf_path)
    cur = con.execute(SQL[name])
    columns = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, cur.fetchall())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, wrong[:3]
