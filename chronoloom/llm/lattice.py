"""Near-duplicate vectors by lattice hashing.

Several tables each project a unit vector to eight dimensions and decode it to the nearest point of
the lattice E8. A vector lives in the cell of its point and also visits neighbouring cells (points at a minimal
vector's distance) whose border is near. Vectors of one label that meet in a cell, at least one of them
at home, are compared by cosine in double precision.

A pair counts once: in the first table where it meets and, if both visit each other, in the lesser
home cell, which each task sees from the codes that travel with a vector. So links are counted, not
listed; what leaves a task are counts by vector and a spanning forest of its links. Equal vectors are one class with a
weight. Cells with more than ``block`` vectors are cut into blocks, and each pair of blocks is a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing; vectors of different lengths are never compared; rows that repeat a vec_id count as vectors of their
own but share links and component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import Union, connected_components, materialize


@lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1, -1), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    p = np.rint(y)
    odd = np.flatnonzero(p.sum(1) % 2)
    if len(odd):
        gap = y[odd] - p[odd]
        worst = np.abs(gap).argmax(1)
        p[odd, worst] += np.where(gap[np.arange(len(odd)), worst] < 0, -1, 1)
    return p


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8."""
    a, b = nearest_even(y), nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=64)
def projections(dim: int, tables: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed + dim)
    return np.array([np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim] for _ in range(tables)])


def codes(unit: np.ndarray, tables: int, probes: int, scale: float, reach: float, seed: int) -> np.ndarray:
    """(vector, table, 1 + probes) cell numbers: home first, then visited cells; unused places repeat the home."""
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    v = minimal_vectors()
    for t, r in enumerate(projections(unit.shape[1], tables, seed)):
        y = unit @ r * (scale * np.sqrt(unit.shape[1] / 64))
        home = decode(y)
        toward = (y - home) @ v.T
        best = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        near = np.take_along_axis(toward, best, 1) >= 1 - reach * np.sqrt(2)  # the border lies at half a minimal vector
        points = np.where(near[:, :, None], home[:, None] + v[best], home[:, None])
        points = np.concatenate((home[:, None], points), 1)
        twice = np.rint(points * 2).astype("<i2").reshape(-1, 8)
        out[:, t] = np.array([xxhash.xxh3_64_intdigest(row.tobytes(), t) for row in twice], np.uint64).view(np.int64).reshape(len(unit), -1)
    return out


def usable(x: list | None) -> bool:
    if not x or any(c is None for c in x):
        return False
    a = np.array(x, np.float64)
    return bool(np.isfinite(a).all() and a.any() and np.isfinite(a @ a) and a @ a > 0)


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = 4, probes: int = 4, scale: float = 6.0, reach: float = 0.36, block: int = 2048, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id and kept."""
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as int) label", "cast(embedding as array<double>) embedding")

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).to_pylist()
            data = [np.array(v, "<f8").tobytes() if label is not None and i is not None and usable(v) else None for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), x, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([d and xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "label", "digest", "vector"])

    known = rows.mapInArrow(identify, "vec_id long, label int, digest binary, vector binary")
    classes = materialize(known.where("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "vectors")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [np.frombuffer(v, "<f8") for v in b.column(3).to_pylist()]
            for dim in sorted({len(v) for v in whole}):
                at = [i for i, v in enumerate(whole) if len(v) == dim]
                m = np.array([whole[i] for i in at])
                code = codes(m / np.sqrt((m * m).sum(1))[:, None], tables, probes, scale, reach, seed)
                cols = [[] for _ in range(5)]
                for k, i in enumerate(at):
                    own = code[k].tobytes()
                    for t in range(tables):
                        for c in dict.fromkeys(code[k, t].tolist()):
                            for col, x in zip(cols, (i, t, c, dim, own), strict=True):
                                col.append(x)
                take = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(cols[4], pa.binary())],
                    names=["label", "tab", "cell", "dim", "rep", "weight", "vector", "codes"],
                )

    key = ["label", "tab", "cell", "dim"]
    placed = classes.select("label", "rep", "weight", "vector").mapInArrow(place, "label int, tab int, cell long, dim int, rep long, weight long, vector binary, codes binary")
    # the sizes need only keys, but they come from the same pass: the table is written once
    placed = materialize(placed, "cells")
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        placed.join(sizes, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "weight", "vector", "codes")
        .repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "rep")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*key, "i", "j", "own", "rep", "weight", "vector", "codes"]
        stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
        for (_, t, cell, _, i, j), group in groupby(stream, key=lambda r: r[:6]):
            g = list(group)
            if len(g) < 2:
                continue
            block_of, rep, weight = (np.array([r[k] for r in g]) for k in (6, 7, 8))
            x = np.array([np.frombuffer(r[9], "<f8") for r in g])
            code = np.array([np.frombuffer(r[10], np.int64).reshape(tables, -1) for r in g])
            norm = np.sqrt((x * x).sum(1))
            home = code[:, t, 0] == cell
            near = np.triu((x @ x.T) / (norm[:, None] * norm) >= least, 1)
            near &= home[:, None] | home
            if i != j:
                near &= block_of[:, None] != block_of
            a, b = np.nonzero(near)
            if not len(a):
                continue

            def meets(s: int, a: np.ndarray = a, b: np.ndarray = b, code: np.ndarray = code) -> tuple[np.ndarray, np.ndarray]:
                return (code[b, s] == code[a, s, :1]).any(1), (code[a, s] == code[b, s, :1]).any(1)

            once = np.ones(len(a), bool)
            for s in range(t):
                forth, back = meets(s)
                once &= ~(forth | back)
            forth, back = meets(t)
            once &= ~(forth & back) | (np.minimum(code[a, t, 0], code[b, t, 0]) == cell)
            a, b = a[once], b[once]
            if not len(a):
                continue
            links = np.bincount(a, weight[b], len(g)) + np.bincount(b, weight[a], len(g))
            union = Union()
            for p, q in zip(rep[a].tolist(), rep[b].tolist(), strict=True):
                union.join(p, q)
            ids = [int(r) for r, n in zip(rep, links, strict=True) if n]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([union.find(r) for r in ids], pa.int64()), pa.array([int(n) for n in links if n], pa.int64())], names=["rep", "root", "links"])

    found = materialize(dealt.mapInArrow(compare, "rep long, root long, links long"), "links")
    linked = connected_components(found.where("rep <> root").selectExpr("rep a", "root b")).withColumnRenamed("id", "rep")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links")).join(linked, "rep", "left")
    per_class = classes.select("label", "digest", "rep", "weight").join(counts, "rep", "left")
    out = known.select("vec_id", "label", "digest").join(per_class, ["label", "digest"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
