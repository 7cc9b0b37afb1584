"""The object graph: every shared surface counts, in one cell and in many."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from chronoloom.operators import graph_store as GS
from chronoloom.plans import catalog


def test_every_shared_entity_counts(spark, tmp_path):
    rows = [(1, "Anna Ben Max Dora"), (2, "Emil Leo Karl Dora"), (3, "Hans Ida Otto Anna")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.src, r.dst): (r.weight, r.etypes) for r in catalog.queries()["d05_object_graph"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (0.25, "SHARED_ENTITY"), (1, 3): (0.25, "SHARED_ENTITY")}


def test_cells(spark):
    rng = random.Random(3)
    rows = [(i * 7, [f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))], [f"e{rng.randint(0, 30)}" for _ in range(rng.randint(0, 6))]) for i in range(60)]
    rows += [(1000, None, None), (1001, [], ["e1", None])]
    kinds = {"T": 0.5, "E": 0.25}
    want = {}
    for (a, s, x), (b, t, y) in combinations(rows, 2):
        n_t, n_e = (len(set(p or []) & set(q or []) - {None}) for p, q in ((s, t), (x, y)))
        if n_t or n_e:
            want[a, b] = (n_t * 0.5 + n_e * 0.25, ",".join(["E"] * (n_e > 0) + ["T"] * (n_t > 0)))
    df = spark.createDataFrame(rows, "id long, T array<string>, E array<string>")
    df = df.withColumn("E", F.filter("E", lambda x: x.isNotNull()))
    for block in (65536, 16):
        found = GS.object_graph(df, kinds, block).collect()
        assert len(found) == len(want) and {(r.src, r.dst): (r.weight, r.etypes) for r in found} == want
