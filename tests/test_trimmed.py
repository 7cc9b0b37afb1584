"""Parts that begin or end with the digit of their place, or with blanks, against the SQL of the queries that cut them."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import extraction as E
from chronoloom.functions import notes as N
from chronoloom.plans import catalog

TEXTS = ["0 a und den 0. 1 b 1. 2 c 2", "One.  Two  \n Three 2\n\n3 four 3", "\u00a0x\u3000. y\u00a0\nz.\u00a0w", "a.\x0bb.\tc.\r\nd", "0", "1. 1", "", None]


@pytest.mark.parametrize("name", ["c03_greedy_pack", "c18_sentences", "f06_redact", "f05_sweep"])
def test_sentences_as_in_sql(spark, tmp_path, name):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall())


def test_other_lists(spark):
    df = spark.createDataFrame([("0, 5 and 21", "![[0.png]] ![[ b1.png ]]", ["0", " 1"])], "v string, t string, l array<string>")
    got = df.select(E.compound_parts(F.col("v")).alias("v"), N.image_embeds(F.col("t")).alias("t"), E.coerced_labels(F.col("l"), F.lit("")).alias("l")).first()
    assert (got.v, got.t, got.l) == (["0", "5", "21"], ["0.png", "b1.png"], ["0", "1"])
