"""Unit vectors, node payloads, note dates and broad questions on small tables."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.notes import note_date
from chronoloom.operators import ranking as R
from chronoloom.operators import vectors as V


def test_put_and_remove(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "node_id long, vec array<double>")
    new = spark.createDataFrame([(2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, None)], "node_id long, vec array<double>")
    got = {r.node_id: r.vec for r in V.put_vectors(stored, new).collect()}
    assert got.pop(2) == pytest.approx([0.6, 0.8]) and got == {1: [1.0, 0.0], 3: [0.0, 0.0], 4: None}
    assert [r.node_id for r in V.remove_vectors(stored, new).collect()] == [1]


def test_payload(spark):
    nodes = spark.createDataFrame([("a", 'x "y"', None, 7)], "id string, name string, kind string, later int")
    assert V.from_payload(V.to_payload(nodes), "name string, kind string, missing int").collect() == [("a", 'x "y"', None, None)]


def test_note_date(spark):
    rows = [({"date": "", "created": "'2024-02-03'"},), ({"date created": "2022"},), ({},)]
    got = spark.createDataFrame(rows, "head map<string,string>").select(note_date(lambda n: F.try_element_at("head", F.lit(n)), F.lit("none")))
    assert [r[0] for r in got.collect()] == ["2024-02-03", "2022", "none"]


def test_breadth(spark):
    rows = [("What are the main topics?",), ("Overall, how was it?",), ("When did Ada overalls arrive?",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "q string").select(R.breadth(F.col("q"))).collect()] == [True, True, False, False]
