"""Rows that repeat a doc_id go only if their own text is a copy."""

import random

from chronoloom.llm.jaccard import one_of_each


def test_rows_with_one_id_and_other_texts(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"{x}{rng.randint(0, 999)}" for _ in range(60)) for x in "abcd")
    rows = [(1, a), (2, b), (2, a + " end"), (3, c), (3, d), (4, d + " end"), (5, ""), (5, ""), (6, b), (6, b), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = one_of_each(df)
    assert got.columns == df.columns
    want = [(1, a), (2, b), (3, c), (3, d), (5, ""), (None, a), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
