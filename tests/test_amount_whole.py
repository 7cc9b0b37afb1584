"""Amounts of every kind, null, negative and large ones too."""

from chronoloom.functions import text as X
from chronoloom.plans import catalog


def test_amounts(spark):
    want = {"$1,300.00": "1300", "$1.0E7": "10000000", "$-1.25E8": "-125000000", "$-5.50": "-5.5", "$1.5E-3": "0.0015", "$0.0": "0", "$12.340": "12.34", "$100": "100", None: None}
    df = spark.createDataFrame([(k,) for k in want], "raw string")
    assert {r.raw: r.amount for r in df.select("raw", X.amount(df["raw"]).alias("amount")).collect()} == want


def test_no_row_is_left_out(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, -3.5), (3, 2.5e7), (4, 10.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.amount for r in catalog.queries()["e23_amount"](spark, str(tmp_path)).collect()} == {1: None, 2: "-3.5", 3: "25000000", 4: "10"}
