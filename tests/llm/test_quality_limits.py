"""Junk between symbols goes, clean prose stays."""

import random

from chronoloom.llm.quality import keep_quality, repetition_quality


def test_symbols_between_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(7))
    junk = " ".join(w + " |" if i % 3 else w for i, w in enumerate(word() for _ in range(120)))  # 80 symbols in 200 words
    clean = " ".join(word() for _ in range(200))
    docs = spark.createDataFrame([(1, junk), (2, clean), (3, clean.replace(" ", " # ", 15))], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition_quality(docs).collect()}
    assert 0.3 < got[1].n_symbols / got[1].n_words < 0.5 and not got[1].base_failed
    assert {i: r.kept for i, r in got.items()} == {1: False, 2: True, 3: True}
    assert sorted(r.doc_id for r in keep_quality(docs).collect()) == [2, 3]
