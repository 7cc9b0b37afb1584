"""Edges, neighbourhoods, derived edges, projection and diffusion."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.keys import dot, idf


def pin(edges: DataFrame) -> DataFrame:
    """Undirected edges with the lesser id first, without loops."""
    return edges.where("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def strongest(edges: DataFrame, key: list[str]) -> DataFrame:
    """Of edges with one key the strongest, the later of equals."""
    order = Window.partitionBy(*key).orderBy(F.desc(F.col("confidence") * F.col("weight")), F.desc("seq"))
    return edges.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def shared_hubs(members: DataFrame, cap: int = 256) -> DataFrame:
    """Pairs of members with a common hub: (member, hub, at) to (src, dst, n_hubs, confidence, weight). A hub counts with its ``cap`` latest members."""
    total = members.select("member").distinct().agg(F.count("*").alias("total"))
    weight = members.groupBy("hub").agg(F.countDistinct("member").alias("df")).crossJoin(F.broadcast(total)).select("hub", idf(F.col("total"), F.col("df")).alias("idf"))
    latest = members.groupBy("member", "hub").agg(F.max("at").alias("at")).withColumn("_n", F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("at"), F.desc("member")))).where(F.col("_n") <= cap)
    a, b = latest.select("hub", F.col("member").alias("src")), latest.select("hub", F.col("member").alias("dst"))
    pairs = a.join(b, "hub").where("src < dst").join(weight, "hub").groupBy("src", "dst").agg(F.count("*").alias("n_hubs"), F.sum("idf").alias("w"))
    return pairs.select("src", "dst", "n_hubs", F.round(F.least(F.lit(1.0), F.col("w") / 3), 3).alias("confidence"), F.round("w", 3).alias("weight"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, floor: float) -> DataFrame:
    """For each query vector its k most similar others by cosine of unit vectors, ties by id."""
    q = queries.select(F.col("node_id").alias("src"), F.col("vec").alias("a"))
    pairs = vectors.select(F.col("node_id").alias("dst"), F.col("vec").alias("b")).join(q, F.col("src") != F.col("dst"))
    scored = pairs.select("src", "dst", F.round(dot(F.col("a"), F.col("b")), 6).alias("score")).where(F.col("score") >= floor)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("rank") <= k)


def nearest_all(vectors: DataFrame, k: int, floor: float, block: int = 4096, wide: int = 65536) -> DataFrame:
    """``nearest`` with every vector as a query: blocks of queries against wide blocks of vectors, the k best of each merged."""
    v = vectors.select(F.col("node_id").cast("long").alias("node_id"), "vec").where("node_id is not null and vec is not null").withColumn("dim", F.size("vec"))
    n = v.count()
    m, n = max(1, -(-n // block)), max(1, -(-n // wide))
    i, j = F.pmod(F.xxhash64("node_id"), F.lit(m)), F.pmod(F.xxhash64("node_id"), F.lit(n))
    a = v.select("dim", i.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias("j"), "node_id", "vec")
    b = v.select("dim", F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")).alias("i"), j.alias("j"), "node_id", "vec")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            (p, x), (q, y) = ((t["node_id"].to_numpy(), t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)) for t in (left, right))
            for at in range(0, len(p), 64):
                s = x[at : at + 64] @ y.T
                r, c = np.nonzero(s >= floor - 1e-6)
                score = s[r, c]
                score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6
                r, c, score = (z[(p[at + r] != q[c]) & (score >= floor)] for z in (r, c, score))
                order = np.lexsort((q[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                for o, z in zip(out, (p[at + r[keep]], q[c[keep]], score[keep]), strict=True):
                    o.append(z)
        return pa.table({name: pa.array(np.concatenate([np.empty(0, kind), *o]).astype(kind)) for name, kind, o in zip(("src", "dst", "score"), (np.int64, np.int64, np.float64), out, strict=True)})

    cells = a.groupBy("dim", "i", "j").cogroup(b.groupBy("dim", "i", "j")).applyInArrow(best, "src long, dst long, score double")
    return cells.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("rank") <= k)


def held(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in ``spark.checkpoint.dir`` (or, where that is unset in local mode, under /tmp): lineage ends here."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"/tmp/chronoloom-{os.getuid()}-{uuid.uuid4().hex[:8]}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(id, component): connected components of (src, dst), each named by its least id. Raises after ``most`` rounds.

    Each round a node takes the least name around it and then that node's own name, so long chains shrink fast.
    """
    step = held(both_ways(edges.select("src", "dst").distinct()), "step")
    name = held(step.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component")), "name")
    for _ in range(most):
        around = step.join(name.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        near = name.join(around, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("before"))
        far = near.join(near.select(F.col("id").alias("component"), F.col("component").alias("onward")), "component", "left")
        new = held(far.select("id", F.least("component", F.coalesce("onward", "component")).alias("component"), "before"), "name")
        name = new.select("id", "component")
        if new.where("component <> before").isEmpty():
            return name
    raise RuntimeError(f"components not settled after {most} rounds")


def projection(edges: DataFrame) -> DataFrame:
    """One weight for each pair: the largest within a type, summed over types."""
    w = F.greatest(F.lit(1e-4), F.col("confidence") * F.col("weight"))
    by_type = pin(edges).groupBy("src", "dst", "etype").agg(F.max(w).alias("w"))
    return by_type.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def transition(pairs: DataFrame) -> DataFrame:
    """Both directions, each row's weights scaled to sum to one."""
    out = both_ways(pairs)
    return out.join(out.groupBy("src").agg(F.sum("w").alias("_d")), "src").select("src", "dst", (F.col("w") / F.col("_d")).alias("p"))


def personalized_rank(pairs: DataFrame, seeds: DataFrame, alpha: float = 0.5, rounds: int = 3) -> DataFrame:
    """Power iteration from the seeds (id, mass): walk on with probability alpha, else start again. The mass of nodes without edges goes back to the seeds."""
    step = transition(pairs)
    rank = seeds.select("id", F.col("mass").alias("r"))
    for _ in range(rounds):
        moved = rank.join(step, rank["id"] == step["src"]).groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("m")).withColumnRenamed("dst", "id")
        rank = moved.join(seeds, "id", "full").select("id", (alpha * F.coalesce("m", F.lit(0.0)) + (1 - alpha) * F.coalesce("mass", F.lit(0.0))).alias("r"))
    return rank


def settled_rank(pairs: DataFrame, seeds: DataFrame, alpha: float = 0.5, most: int = 200, tol: float = 1e-6) -> DataFrame:
    """``personalized_rank`` from a uniform start until a round moves less than ``tol`` a node in all; raises after ``most`` rounds.

    Seeds outside the graph don't count, the others' masses are scaled to sum to one; without any there are no rows.
    """
    step = held(transition(pairs), "step")
    nodes = step.select(F.col("src").alias("id")).distinct()
    mass = seeds.join(nodes, "id", "left_semi").groupBy("id").agg(F.sum("mass").alias("mass"))
    mass = held(mass.crossJoin(F.broadcast(mass.agg(F.sum("mass").alias("_t")))).select("id", (F.col("mass") / F.col("_t")).alias("mass")), "mass")
    if mass.isEmpty():
        return mass.select("id", F.col("mass").alias("r"))
    n = nodes.count()
    rank = nodes.select("id", F.lit(1.0 / n).alias("r"))
    for _ in range(most):
        moved = rank.join(step, rank["id"] == step["src"]).groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("m")).withColumnRenamed("dst", "id")
        new = moved.join(mass, "id", "left").select("id", (alpha * F.col("m") + (1 - alpha) * F.coalesce("mass", F.lit(0.0))).alias("new"))
        both = held(rank.join(new, "id"), "rank")
        rank = both.select("id", F.col("new").alias("r"))
        if both.agg(F.sum(F.abs(F.col("new") - F.col("r")))).first()[0] < n * tol:
            return rank
    raise RuntimeError(f"rank not settled after {most} rounds")


def hops(pairs: DataFrame, starts: DataFrame, limit: int = 5) -> DataFrame:
    """Least number of steps from any start, up to ``limit``."""
    step = held(both_ways(pairs.select("src", "dst")), "step")
    seen = new = held(starts.select("id", F.lit(0).alias("hop")).distinct(), "hop")
    for h in range(1, limit + 1):
        new = new.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        new = held(new.withColumn("hop", F.lit(h)), "hop")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def settled_labels(pairs: DataFrame, most: int = 1000) -> DataFrame:
    """Communities by label propagation until each node has a label with the most weight around it; raises after ``most`` rounds.

    A node moves only to a strictly heavier label (the least of equals), and of neighbours that would move only the first
    by degree and id does. So each round adds to the weight within labels, and labels can't swing to and fro.
    """
    step = held(both_ways(pairs), "step")
    label = step.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).withColumn("label", F.col("id"))
    for _ in range(most):
        around = step.join(label.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.round(F.sum("w"), 9).alias("w"))
        own = around.join(label.select("id", F.col("label").alias("own"), "degree"), "id")
        best = own.groupBy("id", "own", "degree").agg(F.min(F.struct(-F.col("w"), "label")).alias("b"), F.max(F.when(F.col("label") == F.col("own"), F.col("w")).otherwise(0.0)).alias("now"))
        best = held(best.select("id", "own", "degree", F.when(-F.col("b")["col1"] > F.col("now"), F.col("b")["label"]).alias("to")), "label")
        wish = best.where("to is not null").select("id", "to", F.struct("degree", "id").alias("turn"))
        if wish.isEmpty():
            return best.select("id", F.col("own").alias("label"))
        near = step.join(wish.select(F.col("id").alias("dst"), F.col("turn").alias("other")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("other").alias("other"))
        go = wish.join(near, "id", "left").where("other is null or turn < other").select("id", "to")
        label = held(best.drop("to").join(go, "id", "left").select("id", "degree", F.coalesce("to", "own").alias("label")), "label")
    raise RuntimeError(f"labels not settled after {most} rounds")
