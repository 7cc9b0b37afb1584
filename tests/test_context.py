"""Choice of candidates and answers without models."""

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import context as C


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.9, [1.0, 0.01]), (1, "c", 0.5, [0.0, 1.0]), (2, "z", 0.3, [1.0, 1.0]), (2, "y", 0.3, [1.0, 1.0])]
    return spark.createDataFrame(rows, "query_id long, id string, base double, vec array<double>")


def order(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_mmr_without_diversity_sorts(pool):
    assert order(C.mmr(pool, 3, 1.0)) == {1: ["a", "b", "c"], 2: ["y", "z"]}


def test_mmr_with_diversity(pool):
    assert order(C.mmr(pool, 2, 0.5)) == {1: ["a", "c"], 2: ["y", "z"]}


def test_hybrid_lanes(spark):
    pool = spark.createDataFrame([(q, f"e{i}", i) for q in range(3) for i in range(1, 7)], "query_id long, id string, rank int")
    lanes = spark.createDataFrame([(0, "single"), (1, "state"), (2, "recency")], "query_id long, lane string")
    days = spark.createDataFrame([(f"e{i}", f"2024-01-{i:02d}") for i in range(1, 10)], "id string, day string")
    facts = spark.createDataFrame([(q, "e9") for q in range(3)], "query_id long, id string")
    ce = lambda items: items.select("query_id", "id", F.substring("id", 2, 5).cast("int").alias("ce"))
    got = order(C.hybrid(pool, lanes, days, facts, 4, ce))
    assert got[0] == ["e1", "e2", "e3", "e4"]  # as the pool
    assert got[1][0] == "e9" and set(got[1]) == {"e9", "e1", "e2", "e3"}  # a fact's episode by the reranker, the pool's best stay
    assert got[2][0] == "e6" and {"e1", "e2", "e3"} <= set(got[2])
