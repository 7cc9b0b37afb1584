"""Merging of names and relations, and extractors, on values of our own."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import extraction as X
from chronoloom.operators import extractors as E
from chronoloom.operators import resolution as RS


@pytest.mark.parametrize("a,b,want", [("likes", "dislikes", True), ("hired", "hired by", True), ("works for", "works at", True), ("", "x", True), ("visits", "visited", False), ("buys", "sells", True)])
def test_veto(spark, a, b, want):
    assert spark.range(1).select(X.merge_vetoed(F.lit(a), F.lit(b)).alias("v")).first().v is want


def test_gate_has_no_critical_merge(spark):
    rows = RS.gate(spark).collect()
    assert not any(r.critical for r in rows) and all(r.said for r in rows if r.gold)
    c = RS.precision_recall(RS.pair_counts(RS.gate(spark).withColumn("k", F.lit(1)), ["k"])).first()
    assert (c.precision, c.recall, c.fp) == (1.0, 1.0, 0)


def test_vectors_resolve_with_types(spark):
    known = spark.createDataFrame([(1, [1.0, 0.0], "person"), (2, [0.0, 1.0], "place")], "node_id long, vec array<double>, entity_type string")
    new = spark.createDataFrame([(11, [0.999, 0.0447], "person"), (12, [0.999, 0.0447], "place"), (13, [0.0, 1.0], "other"), (14, [0.7, 0.71], "person")], known.schema)
    assert {r.node_id: r.match for r in RS.resolve_by_vector(new, known, 0.93).collect()} == {11: 1, 12: None, 13: 2, 14: None}


def test_fresh_ids(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "n long").repartition(5)
    got = {r.n: r.id for r in RS.fresh_ids(df, "e", "n", 3).collect()}
    assert got == {i: f"e_{i + 4:04d}" for i in range(101)}


def test_extractors(spark):
    items = spark.createDataFrame([(1, "text", "", "Ana saw Berlin without delay"), (2, "file", "", "Ana"), (3, "link", "Title Page", "about Rome")], "id long, kind string, title string, text string")
    got = {r.id: (r.entities, r.tags) for r in E.extract(items, E.extractor("mock")).collect()}
    assert got == {1: (["ana", "berlin"], ["berlin", "without", "delay"]), 2: ([], []), 3: (["title", "page", "rome"], ["title", "about"])}
    with pytest.raises(ValueError):
        E.extractor("unheard of")
    own = E.extractor("own", own=lambda: E.Composed(lambda t: F.array(F.lit("x")), lambda t: F.array(F.lit("y"))))
    assert E.extract(items.where("id = 1"), own).first().tags == ["y"]


def test_gated(spark):
    items = spark.createDataFrame([(1, "text", "", "Ana quit"), (2, "text", "", "Ben sings")], "id long, kind string, title string, text string")
    seen = []

    def closer(df):
        seen.extend(r.id for r in df.collect())
        return df.select("id", F.array(F.lit("job")).alias("entities"), F.array(F.lit("work")).alias("tags"))

    got = {r.id: (r.entities, r.escalated) for r in E.gated(items, E.extractor("mock"), closer).collect()}
    assert seen == [1] and got == {1: (["job", "ana"], True), 2: (["ben"], False)}
