"""Signatures of the Jaccard join: partners keep one in common whatever their frequencies are."""

from collections import Counter

import numpy as np

from chronoloom.llm.jaccard import Bands, candidate_edges, signatures


def kept(sets, num, den):
    bands = Bands(num, den)
    made = [signatures(u, bands) for u in sets]
    times = Counter(s for m in made for sig, _ in m for s in sig.tolist())
    return [{s for sig, spare in m for s in sorted(sig.tolist(), key=lambda s: (times[s], s))[: len(sig) - spare]} for m in made]


def test_partners_share_a_kept_signature():
    rng = np.random.default_rng(5)

    def fresh(n):
        return rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)

    passages, sets = [fresh(n) for n in (10, 60, 200)], []
    for size in (1, 2, 3, 5, 9, 20, 47, 120, 300, 900):
        for p in passages:
            base = np.unique(np.concatenate((fresh(size), p)))
            for share in (1.0, 0.97, 0.93, 0.9, 0.85):
                sets.append(np.unique(base[rng.random(len(base)) < share]))
                sets.append(np.unique(np.concatenate((sets[-1], fresh(int(len(base) * (1 - share) / 2))))))
    sets = [s for s in sets if len(s)]
    for num, den in ((80, 100), (85, 100)):
        have, links = kept(sets, num, den), 0
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j], assume_unique=True))
                if den * both >= num * (len(a) + len(sets[j]) - both):
                    links += 1
                    assert have[i] & have[j], (len(a), len(sets[j]), both)
        assert links > 300


def test_repeated_ids_with_other_texts(spark):
    """Rows of one doc_id with different texts leave out no more than each of them may."""
    words = [f"w{i}" for i in range(90)]
    near = words[:44] + ["x"] + words[45:]
    rows = [(1, " ".join(words)), (1, " ".join(f"v{i}" for i in range(90))), (2, " ".join(near)), (3, " ".join(f"v{i}" for i in range(88)))]
    edges = candidate_edges(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert {(r.a, r.b) for r in edges} == {(2, 1), (3, 1)}
