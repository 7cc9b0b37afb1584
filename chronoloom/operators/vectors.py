"""The vector store as a table of unit vectors, and codecs of stored nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import keys as K
from chronoloom.operators.store import upsert


def unit(vec: Column) -> Column:
    """The vector with length 1; a zero vector stays."""
    length = K.norm(vec)
    return F.when(length > 0, F.transform(vec, lambda x: x / length)).otherwise(vec)


def put_vectors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored vectors with the incoming ones added, or in place of those with their node_id, as unit vectors."""
    return upsert(stored, incoming.withColumns({"vec": unit(F.col("vec")), "removed": F.lit(False)}), ["node_id"])


def remove_vectors(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored vectors without those of the node_ids given."""
    return stored.join(gone.select("node_id"), "node_id", "left_anti")


def to_payload(nodes: DataFrame) -> DataFrame:
    """id and all other columns of a node as JSON."""
    return nodes.select("id", F.to_json(F.struct(*[c for c in nodes.columns if c != "id"])).alias("payload"))


def from_payload(payloads: DataFrame, schema: str) -> DataFrame:
    """Nodes from their JSON; keys that the schema doesn't name are left out, missing ones are null."""
    return payloads.select("id", F.from_json("payload", schema).alias("_node")).select("id", "_node.*")
