"""Saving, merging and erasing nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import REDACTED, redaction_tokens, sentences


def upsert(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """The next snapshot: rows of delta in place of those with their key, deleted where ``removed``."""
    kept = base.join(delta.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(delta.where("not removed").drop("removed"))


def merge_nodes(edges: DataFrame, losers: DataFrame) -> DataFrame:
    """Edges (src, dst, etype, ...) moved from each loser to its survivor, without the loops this makes; of equal edges the strongest."""
    a, b = (losers.select(F.col("loser").alias(c), F.col("survivor").alias(f"_{c}")) for c in ("src", "dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").withColumns({"src": F.coalesce("_src", "src"), "dst": F.coalesce("_dst", "dst")}).drop("_src", "_dst")
    order = Window.partitionBy("src", "dst", "etype").orderBy(F.desc(F.col("confidence") * F.col("weight")), F.desc("seq"))
    return moved.where("src <> dst").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def tombstone(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """All facts, those of the given episodes (episode_id) invalid and retracted."""
    gone = episodes.select("episode_id").distinct().withColumn("_gone", F.lit(True))
    marked = facts.join(gone, "episode_id", "left").withColumn("valid", F.col("_gone").isNull())
    return marked.withColumn("belief", F.when(F.col("valid"), "asserted").otherwise("retracted")).drop("_gone")


def orphans(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes (id) that no valid fact touches any more."""
    live = facts.where("valid").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(live, "id", "left_anti")


def secret_marks(text: Column, secret: Column, least: float = 0.8, span: float = 0.5) -> Column:
    """For each sentence whether it holds the secret: as a substring, or enough of its tokens (two at least) with enough of the sentence's own."""
    asked = redaction_tokens(secret)

    def holds(s: Column) -> Column:
        own = redaction_tokens(s)
        common = F.size(F.array_intersect(own, asked))
        return F.contains(F.lower(s), F.lower(secret)) | ((common >= 2) & (common >= least * F.size(asked)) & (common >= span * F.size(own)))

    return F.transform(sentences(text), holds)


def redact(text: Column, secret: Column) -> Column:
    """The text's sentences, those that hold the secret replaced; null where nothing else is left."""
    parts = F.zip_with(sentences(text), secret_marks(text, secret), lambda s, m: F.when(m, F.lit(REDACTED)).otherwise(s))
    return F.when(F.exists(parts, lambda p: p != REDACTED), F.array_join(parts, " "))
