"""Which surfaces are one node: keys, nearest names, types, aliases, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import extraction as X
from chronoloom.functions import keys as K
from chronoloom.operators.graph import nearest_all
from chronoloom.operators.graph_store import category  # noqa: F401


def resolve_by_key(rows: DataFrame, key: str, surface: str, order: list[str]) -> DataFrame:
    """Each row with the surface that came first with its key."""
    first = rows.groupBy(key).agg(F.min_by(surface, F.struct(*order)).alias("first"))
    return rows.join(first, key)


def resolve_by_vector(new: DataFrame, known: DataFrame, floor: float, compatible: bool = True) -> DataFrame:
    """New names (node_id, vec, entity_type) with the nearest known one of a compatible type at or above the floor; null: it is new."""
    every = known.select("node_id", "vec").unionByName(new.select("node_id", "vec"))
    near = nearest_all(every, 5, floor)
    typed = near.join(new.select(F.col("node_id").alias("src"), F.col("entity_type").alias("a")), "src").join(known.select(F.col("node_id").alias("dst"), F.col("entity_type").alias("b")), "dst")
    fit = typed.where(X.types_compatible(F.col("b"), F.col("a"))) if compatible else typed
    best = fit.groupBy("src").agg(F.min_by("dst", "rank").alias("match"))
    return new.join(best, F.col("node_id") == F.col("src"), "left").select("node_id", "match")


def synonymy_links(vectors: DataFrame, most: int, floor: float) -> DataFrame:
    """SIMILAR_TO edges to the nearest names of the same kind (node_id, label, vec)."""
    # the kind goes first: names of other kinds are never compared
    kinds = vectors.select("label").distinct()
    out = None
    for row in kinds.toLocalIterator():  # kinds of nodes: a handful
        part = nearest_all(vectors.where(F.col("label") == row["label"]), most, floor)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = nearest_all(vectors, most, floor)
    return out.select("src", "dst", F.lit("SIMILAR_TO").alias("etype"), F.col("score").alias("confidence"), F.col("score").alias("weight"))


def upgraded_types(rows: DataFrame, node: str, kind: str, order: str) -> DataFrame:
    """Each node's first type that says something, else "other"."""
    first = F.min_by(kind, F.when(F.col(kind) != "other", F.col(order)))
    return rows.groupBy(node).agg(F.coalesce(first, F.lit("other")).alias(kind))


def aliases(resolved: DataFrame, key: str, surface: str) -> DataFrame:
    """The other surfaces of each resolved node, in order of the alphabet."""
    other = resolved.where(F.col(surface) != F.col("first")).groupBy(key, "first").agg(F.array_sort(F.collect_set(surface)).alias("aliases"))
    return other


def reattach(edges: DataFrame, losers: DataFrame, symmetric: list[str]) -> DataFrame:
    """Edges of merged nodes at their survivors: no loops, relations without direction with the lesser end first."""
    a, b = (losers.select(F.col("loser").alias(c), F.col("survivor").alias(f"_{c}")) for c in ("src", "dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").withColumns({"src": F.coalesce("_src", "src"), "dst": F.coalesce("_dst", "dst")}).where("src <> dst")
    pin = F.col("rel").isin(symmetric)
    return moved.withColumns({"src": F.when(pin, F.least("src", "dst")).otherwise(F.col("src")), "dst": F.when(pin, F.greatest("src", "dst")).otherwise(F.col("dst"))}).select(edges.columns)


def endpoints(asked: DataFrame, entities: DataFrame, tags: DataFrame) -> DataFrame:
    """The node of each surface of a document (doc_id, surface): its entity, else its tag, else a tag of any document, else a new one."""
    own = asked.join(entities.distinct().withColumn("_e", F.lit(True)), ["doc_id", "surface"], "left").join(tags.distinct().withColumn("_t", F.lit(True)), ["doc_id", "surface"], "left")
    every = own.join(tags.select("surface").distinct().withColumn("_g", F.lit(True)), "surface", "left")
    prefix = F.when(F.col("_e"), "entity_").when(F.col("_t") | F.col("_g"), "tag_").otherwise("new_")
    return every.select("doc_id", "surface", F.concat(prefix, "surface").alias("node"))


def distinct_surfaces(*sets: DataFrame) -> DataFrame:
    """Every trimmed surface once, so that each is embedded once."""
    every = sets[0].select(F.trim("surface").alias("surface"))
    for s in sets[1:]:
        every = every.unionByName(s.select(F.trim("surface").alias("surface")))
    return every.distinct()


def fresh_ids(rows: DataFrame, prefix: str, order: str, used: int = 0) -> DataFrame:
    """Ids prefix_0001 and on in the given order, after the ``used`` first. Numbers come from sorted partitions and their sizes, so no task gets all rows."""
    spark = rows.sparkSession
    ranked = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranked = ranked.withColumn("_i", F.col("_m") - (F.col("_p").cast("long") * F.lit(1 << 33)))
    sizes = {r["_p"]: r["count"] for r in ranked.groupBy("_p").count().collect()}  # a number for each partition
    start, at = [], used
    for p in sorted(sizes):
        start.append((p, at))
        at += sizes[p]
    offsets = spark.createDataFrame(start, "_p int, _o long")
    numbered = ranked.join(F.broadcast(offsets), "_p").withColumn("id", F.format_string(f"{prefix}_%04d", F.col("_o") + F.col("_i") + 1))
    return numbered.drop("_p", "_m", "_i", "_o")


#: Ours: pairs of relations, and whether they are one.
GATE_PAIRS = [
    ("lives in", "is living in", True), ("works at", "worked at", True), ("friend of", "friends of", True), ("likes", "dislikes", False), ("hired by", "hired", False),
    ("sold", "bought", False), ("works for", "works with", False), ("visits", "visited", True), ("sends", "receives", False), ("married to", "is married to", True),
]


def gate(spark: SparkSession, pairs: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """Pairs of relations that the keys would merge or part, beside what is right; ``critical`` marks a wrong merge."""
    df = spark.createDataFrame(GATE_PAIRS if pairs is None else pairs, "a string, b string, gold boolean")
    said = (K.relation_key(F.col("a")) == K.relation_key(F.col("b"))) & ~X.merge_vetoed(F.col("a"), F.col("b"))
    return df.withColumn("said", said).withColumn("critical", F.col("said") & ~F.col("gold"))


def pair_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """True and false positives and negatives of (said, gold)."""
    s, g = F.col("said"), F.col("gold")
    return rows.groupBy(*by).agg(F.count_if(s & g).alias("tp"), F.count_if(s & ~g).alias("fp"), F.count_if(~s & g).alias("fn"), F.count_if(~s & ~g).alias("tn"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Counts with precision and recall; 1 where there is nothing to find."""
    ratio = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 6)).otherwise(1.0)
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn"))})


