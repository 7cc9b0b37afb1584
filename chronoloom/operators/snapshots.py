"""Tables as snapshots: each save is a folder of its own, and a small pointer names the current one."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from chronoloom.errors import StoreError

NODES = "id string, ntype string, name string, valid boolean, created_at string, entity_type string, aliases array<string>, doc_frequency long"
EDGES = "src string, dst string, etype string, rel string, confidence double, weight double, valid_at string, invalid_at string, belief string, episode_id string, seq long"
VECTORS = "node_id string, kind string, vec array<float>"
CACHE = "content_hash string, node_id string"
TABLES = {"nodes": NODES, "edges": EDGES, "vectors": VECTORS, "hash_cache": CACHE}


class Store:
    """Open or create a store at a path that all of the cluster can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._at(f"{n}/_DONE")))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of the newest snapshot, or of one version; columns that an older one lacks are null, those we don't know go."""
        if table not in TABLES:
            raise StoreError(f"no table {table!r}")
        schema = StructType.fromDDL(TABLES[table])
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{found[-1] if version is None else version}/{table}")

    def save(self, **tables: DataFrame) -> int:
        """Write a new snapshot; tables that aren't given are carried over. It counts once all of it is there."""
        version = (self.versions() or [0])[-1] + 1
        for name in TABLES:
            schema = StructType.fromDDL(TABLES[name])
            df = tables[name] if name in tables else self.read(name)
            (df.select([f.name for f in schema]) if name in tables else df).write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        self._fs.create(self._at(f"v{version}/_DONE"), True).close()
        return version


def cache_key(instance: str, sessions: list[str], settings: dict) -> str:
    """A name for what a store of these sessions under these settings holds."""
    body = json.dumps({"instance": instance, "sessions": sessions, "settings": settings}, sort_keys=True)
    return hashlib.sha256(body.encode()).hexdigest()[:32]


def restored(spark: SparkSession, cache: str, key: str, work: str) -> Store | None:
    """A working copy of a cached store, or nothing."""
    kept = Store(spark, f"{cache}/{key}")
    if not kept.versions():
        return None
    copy = Store(spark, work)
    copy.save(**{t: kept.read(t) for t in TABLES})
    return copy
