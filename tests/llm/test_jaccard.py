"""The Jaccard join against all pairs, on families of near copies and edge cases."""

import random

from chronoloom.llm.jaccard import jaccard_components


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    comp = {i: i for i in ids}
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and den * len(a & b) >= num * len(a | b):
                lo, hi = sorted((comp[x], comp[y]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def family(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice("abcdefghij") * rng.randint(1, 5)
    return " ".join(w)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows, k = [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, " \n\t"), (5, "one two three")], 6
    for size in (4, 5, 7, 12, 30, 60, 150, 400):
        base = [rng.choice("klmnopqrstu") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(size)]
        for edits in (0, 0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8):
            rows.append((k, family(rng, base, edits)))
            k += 1
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cluster string").repartition(5)
    for n, num, den, block in ((4, 85, 100, 4096), (5, 80, 100, 3)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, n, num, den, block).collect()}
        assert got == brute(rows, n, num, den)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(df, 4, 85, 100).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(df, 4, 85, 100).collect())[1:] == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
