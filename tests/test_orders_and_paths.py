"""Orders without a window over all rows, and paths deeper than any number of rounds."""

from chronoloom.sources import chats
from chronoloom.sources import corpus as CO


def test_no_window_over_a_whole_kind(spark):
    rows = [("a" if i % 5 else None if i % 2 else "b", i * 37 % 101) for i in range(101)]
    found = CO.interleaved(spark.createDataFrame(rows, "kind string, id long"))
    by_kind = {}
    for kind, i in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        by_kind.setdefault(kind, []).append(i)
    want = sorted((round((n - 0.5) / len(ids), 9), kind or "", i) for kind, ids in by_kind.items() for n, i in enumerate(ids, 1))
    got = sorted((r.place, r.kind or "", r.id) for r in found.collect())
    assert got == [(n, kind, i) for n, (_, kind, i) in enumerate(want, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("windowspecdefinition(_p" in line for line in plan.splitlines() if "row_number()" in line)


def test_deep_paths(spark):
    n = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(200)] + [(2, 5, 5), (3, 1, 2), (3, 2, 1), (4, 3, 1), (4, 3, 2)], "conv_id long, id long, parent long")
    s = spark.createDataFrame([(1, 199), (2, 5), (3, 1), (4, 3), (9, 9)], "conv_id long, id long")
    got = sorted(tuple(r) for r in chats.path_to_root(n, s).collect())
    assert got == sorted([(1, 199 - u, u) for u in range(200)] + [(2, 5, 0), (3, 1, 0), (3, 2, 1), (4, 3, 0), (4, 1, 1), (4, 2, 1), (9, 9, 0)])
