"""The merge that lets facts leave early, against one that keeps them all."""

import random

from chronoloom.operators import fact_merge as M


def statements(n, seed):
    rng = random.Random(seed)
    at = lambda: f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    return [
        {"src": rng.choice("abcdef"), "rel": "r", "dst": rng.choice("abcdef"), "at": at(), "seq": i, "confidence": rng.choice([0.1, 0.5, 0.9]), "episode_id": f"e{rng.randint(0, n // 2)}",
         "status": rng.choice(["asserted"] * 4 + ["ended", "retracted"]), "valid_from": rng.choice(["", "", at()]), "valid_to": rng.choice(["", "", "", at()])}
        for i in range(n)
    ]


def shape(facts):
    return sorted(repr([f[n] for n in M._NAMES]) for f in facts)


def test_same_facts_and_few_kept():
    for seed in range(60):
        rows = sorted(statements(300, seed), key=lambda r: (r["at"], r["seq"]))
        plain, bounded, out = M.Merge(True, True), M.Bounded(), []
        most = 0
        for r in rows:
            plain.apply(r)
            bounded.apply(r)
            out += bounded.drain()
            most = max(most, len(bounded.facts))
        for i in list(bounded.facts):
            bounded._leave(i)
        out += bounded.drain()
        got = [f for pair in sorted({(o["src"], o["dst"]) for o in out}) for f in M._retracted((dict(o) for o in out if (o["src"], o["dst"]) == pair), bounded.margin)]
        assert shape(got) == shape(plain.facts)
        assert most < len(plain.facts) / 2


def test_as_a_table(spark):
    rows = statements(400, 99)
    plain = M.Merge(True, True)
    for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
        plain.apply(r)
    got = M.merge_facts(spark.createDataFrame(rows, "src string, rel string, dst string, at string, seq long, confidence double, episode_id string, status string, valid_from string, valid_to string"), True, True).collect()
    assert shape([r.asDict() for r in got]) == shape(plain.facts)
