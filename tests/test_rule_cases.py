"""Every rule against what must come of its hand-made rows."""

import duckdb
import pytest

from tests.rule_cases import CASES
from tests.test_oracles import rows_of


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, sf_dir, name):
    query, sql = CASES[name]
    df, cur = query(spark, sf_dir), duckdb.connect().execute(sql)
    columns = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())
