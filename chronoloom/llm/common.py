"""What several training-data operators share: shared storage, word hashes, Arrow mapping."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a folder under /tmp is set for this session,
    in local mode only: on a cluster executors share no such folder, and this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get() if jdir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"/tmp/chronoloom-{os.getuid()}-{uuid.uuid4().hex[:8]}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into shared storage and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], times: str, total: int, how: str = "inner", parts: int = 2048, least: int = 256) -> DataFrame:
    """``rows`` joined to ``keyed``, a row for each key with how many rows have it, of ``total`` in all.

    Keys of more than total / parts rows (so fewer than ``parts`` keys, however large the table) are looked up in a
    broadcast table, and their rows stay where they are; the other keys' rows are dealt by key.
    """
    limit = max(least, total // parts)
    hot = F.broadcast(keyed.where(F.col(times) > limit).drop(times))
    cold = keyed.where(F.col(times) <= limit).drop(times)
    rest = rows.join(F.broadcast(keyed.where(F.col(times) > limit).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold, on, how))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay at a few MB, in the JVM and in Python workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, after which a Python worker that waits for its next task gives its free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:
            pass  # another C library

    return run


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for j in range(n):
        acc = acc * base + h[j : len(h) - n + 1 + j]
    return mix64(acc)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours in a sorted array."""
    if not len(keys):
        e = np.empty(0, np.int64)
        return e, e
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))


class Union:
    """Union-find over arbitrary keys; each root is the least key of its set."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by a spanning forest of stars."""
    union = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            union.join(a, b)
    rows = [(x, r) for x in list(union.up) if (r := union.find(x)) != x]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in edges (a, b); component is the least id reachable.

    Large-star and small-star rounds on tables in shared storage until only stars are left; a round's table goes once the
    next is written. A star's centre may have any number of edges: they are joined (``spread_join``), never gathered.
    """
    spark = edges.sparkSession

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_dir(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    e, path = keep(edges.selectExpr("cast(a as long) a", "cast(b as long) b").mapInArrow(trimmed(_local_forest), "a long, b long").distinct())
    while True:
        many = e.groupBy("a").count().where("count > 1").select("a")
        chained = e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi")
        if many.unionByName(chained).isEmpty():
            return e.selectExpr("a as id", "b as component").unionByName(e.selectExpr("b as id", "b as component").distinct())
        total = e.count()
        both = e.unionByName(e.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large, old = keep(spread_join(both.where("b > a"), least, ["a"], "n", 2 * total).where("b > m").selectExpr("b as a", "m as b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, ["a"], "n", 2 * total).where("b > m").selectExpr("b as a", "m as b").unionByName(low.selectExpr("a", "m as b")).distinct()
        gone = path
        e, path = keep(small)
        delete_path(spark, gone)
        delete_path(spark, old)
