"""Stupid backoff against a direct computation."""

import math
import random
from collections import Counter

import pytest

from chronoloom.llm.stupid_backoff import backoff_scores


def brute(rows):
    docs = {i: (t or "").split() for i, t in rows}
    grams = lambda w, n: Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    own = {i: [grams(w, n) for n in (1, 2, 3)] for i, w in docs.items()}
    every = [sum((own[i][n] for i in docs), Counter()) for n in range(3)]
    words = sum(map(len, docs.values()))
    out = {}
    for i, w in docs.items():
        c = lambda g, i=i: every[len(g) - 1][g] - own[i][len(g) - 1][g]
        tally, logs = [0, 0, 0, 0], 0.0
        for j in range(len(w)):
            s, scale, done = 0.0, 1.0, False
            for n in (3, 2):
                if j >= n - 1 and not done:
                    g = tuple(w[j - n + 1 : j + 1])
                    if c(g) > 0:
                        s, done = scale * c(g) / c(g[:-1]), True
                        tally[3 - n] += 1
                    else:
                        scale *= 0.4
            if not done:
                k = c((w[j],))
                s = scale * max(k, 0.5) / max(1, words - len(w))
                tally[2 if k > 0 else 3] += 1
            logs += math.log10(s)
        out[i] = (len(w), *tally, logs / len(w) if w else None)
    return out


@pytest.mark.parametrize("chunk,bits,block", [(50, 48, 7), (1 << 20, 64, 100)])
def test_scores(spark, chunk, bits, block):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "a"), (83, rows[3][1]), (84, "zz zz zz zz"), (85, "a b"), (86, " \n ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int").repartition(3)
    got, want = {r.doc_id: tuple(r)[1:] for r in backoff_scores(df, chunk, bits, block_words=block).collect()}, brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:-1] == want[k][:-1], k
        assert got[k][-1] == pytest.approx(want[k][-1]) if want[k][-1] is not None else got[k][-1] is None


def test_empty(spark):
    assert backoff_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
