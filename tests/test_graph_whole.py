"""Graph operators that once did less than the whole job, against plain computations."""

import random

import numpy as np
import pytest

from chronoloom.operators import graph as G
from chronoloom.plans import catalog


def test_hubs_count_more_than_16_members(spark):
    rows = [(f"m{i:02}", hub, f"2024-01-{i + 1:02}") for i in range(20) for hub in ("h1", "h2")]
    got = {(r.src, r.dst): r.n_hubs for r in G.shared_hubs(spark.createDataFrame(rows, "member string, hub string, at string")).collect()}
    assert got == {(f"m{i:02}", f"m{j:02}"): 2 for i in range(20) for j in range(i + 1, 20)}


def test_d01_counts_every_pair(spark):
    from chronoloom.operators.graph import shared_hubs
    from chronoloom.sources.tables import fact_stream
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    m = fact_stream(spark, d).select(F.col("src").alias("member"), F.concat("dst", F.lit("/"), "rel").alias("hub"), "at")
    full = catalog.queries()["d01_shared_hubs"](spark, d).agg({"n_hubs": "sum"}).first()[0]
    cut = shared_hubs(m, cap=2).agg({"n_hubs": "sum"}).first()[0]
    assert full == shared_hubs(m, cap=256).agg({"n_hubs": "sum"}).first()[0] > cut



@pytest.mark.parametrize("block", [(7, 13), (4096, 65536)])
def test_nearest_of_all_vectors(spark, block):
    x = np.random.default_rng(3).normal(size=(60, 5))
    x[50:] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)]
    got = sorted(map(tuple, G.nearest_all(spark.createDataFrame(rows, "node_id long, vec array<double>"), 4, 0.3, *block).collect()))
    want = []
    for i in range(60):
        near = sorted((-round(float(x[i] @ x[j]), 6), j) for j in range(60) if j != i)
        want += [(i, j, -s, n + 1) for n, (s, j) in enumerate(near[:4]) if -s >= 0.3]
    assert got == sorted(want)
    assert {r[0] for r in got} > {r[0] for r in got if r[0] % 10 == 0}


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    edges = {(f"n{i:02}", f"n{i + 1:02}"): 1.0 for i in range(12)}  # a path: further than two hops
    edges |= {tuple(sorted((f"u{rng.randint(0, 20):02}", f"v{rng.randint(0, 8)}"))): rng.randint(1, 9) / 4 for _ in range(60)}
    return [(a, b, w) for (a, b), w in edges.items()]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string, w double")


def around(pairs):
    out = {}
    for a, b, w in pairs:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def test_hops_to_the_cutoff(spark, pairs):
    got = G.hops(frame(spark, pairs), spark.createDataFrame([("n00",), ("n00",)], "id string")).collect()
    assert sorted((r.id, r.hop) for r in got) == [(f"n{i:02}", i) for i in range(6)]


def test_rank_settles(spark, pairs):
    near = around(pairs)
    ids = sorted(near)
    p = np.array([1.0 if i == "n03" else 0.0 for i in ids])
    a = np.array([[near[i].get(j, 0) / sum(near[i].values()) for j in ids] for i in ids])
    x = np.full(len(ids), 1 / len(ids))
    while True:
        last, x = x, 0.5 * x @ a + 0.5 * p
        if np.abs(x - last).sum() < len(ids) * 1e-6:
            break
    seeds = spark.createDataFrame([("n03", 2.0), ("elsewhere", 5.0)], "id string, mass double")
    got = {r.id: r.r for r in G.settled_rank(frame(spark, pairs), seeds).collect()}
    assert got == pytest.approx(dict(zip(ids, x)), abs=1e-12)
    with pytest.raises(RuntimeError):
        G.settled_rank(frame(spark, pairs), seeds, most=2)
    assert G.settled_rank(frame(spark, pairs), spark.createDataFrame([("elsewhere", 1.0)], "id string, mass double")).count() == 0


def test_labels_settle(spark, pairs):
    near = around(pairs)
    label = {r.id: r.label for r in G.settled_labels(frame(spark, pairs)).collect()}
    assert set(label) == set(near)
    for i, n in near.items():
        w = {}
        for j, x in n.items():
            w[label[j]] = w.get(label[j], 0) + x
        assert w.get(label[i], 0) == max(w.values())  # the stop rule
    assert len(set(label.values())) < len(label)
