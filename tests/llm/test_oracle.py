"""Operators that have SQL against it, over the whole small table."""

import duckdb
import pytest

from chronoloom.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.SQL))
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = duck.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
