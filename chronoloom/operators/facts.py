"""Bi-temporal facts: windows, views as of a date, and the ordered merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATE = 0.3  #: how much weaker a statement may be than the fact it would change


def supersede(facts: DataFrame) -> DataFrame:
    """Functional relations: each new value ends the one before. Repeats of the open value only confirm it."""
    order = Window.partitionBy("src", "rel").orderBy("at", "seq")
    changed = facts.withColumn("before", F.lag("dst").over(order)).where("before is null or before <> dst")
    after = F.lead("at").over(order)
    return changed.select("src", "rel", "dst", F.col("at").alias("valid_at"), F.coalesce(after, F.lit("")).alias("invalid_at"), "episode_id", "confidence", "seq")


def active(as_of: str | None, belief: Column | None = None) -> Column:
    """Whether a fact holds at a date, or now. Dates are ISO texts, compared as texts; empty is open."""
    start, end = F.col("valid_at"), F.col("invalid_at")
    held = end == "" if as_of is None else ~((start != "") & (start > as_of)) & ~((end != "") & (end <= as_of))
    return held if belief is None else held & (belief == "asserted")


def fact_line() -> Column:
    start, end = F.substring("valid_at", 1, 10), F.substring("invalid_at", 1, 10)
    window = (
        F.when((F.col("valid_at") != "") & (F.col("invalid_at") != ""), F.concat(F.lit(" (since "), start, F.lit("; until "), end, F.lit("; ended)")))
        .when(F.col("valid_at") != "", F.concat(F.lit(" (mentioned "), start, F.lit(")"))).otherwise("")
    )
    source = F.when(F.col("episode_id") != "", F.concat(F.lit(" ["), F.col("episode_id"), F.lit("]"))).otherwise("")
    return F.concat("src", F.lit(" --"), "rel", F.lit("--> "), "dst", window, source)


def confirm(facts: DataFrame) -> DataFrame:
    """Repeated statements of one fact: the earliest start, the best confidence, the episodes that confirm."""
    return facts.groupBy("src", "rel", "dst").agg(F.min("at").alias("valid_at"), F.max("confidence").alias("confidence"), F.countDistinct("episode_id").alias("n_episodes"))


def history(facts: DataFrame, limit: int = 40) -> DataFrame:
    once = facts.dropDuplicates(["src", "rel", "dst", "valid_at", "invalid_at"])
    return once.orderBy("valid_at", "src", "rel", "dst", "invalid_at").limit(limit)


def close(facts: DataFrame, ends: DataFrame) -> DataFrame:
    """Open facts that an end (src, rel, dst, at, episode_id) names, closed at its date by its episode; of several ends the first by date."""
    first = ends.groupBy("src", "rel", "dst").agg(F.min(F.struct("at", F.col("episode_id").alias("by"))).alias("_e"))
    joined = facts.join(first, ["src", "rel", "dst"], "left")
    hit = F.col("_e").isNotNull() & (F.col("invalid_at") == "") & (F.col("belief") == "asserted")
    return joined.withColumns({"closed_by": F.when(hit, F.col("_e.by")), "invalid_at": F.when(hit, F.col("_e.at")).otherwise(F.col("invalid_at"))}).drop("_e")


def gated(stored: Column, incoming: Column, margin: float = GATE) -> Column:
    """Whether a statement is too weak to change a fact."""
    return incoming < stored - margin


def new_fact(at: Column) -> dict[str, Column]:
    """What a statement that opens a fact adds to its row."""
    return {"weight": F.col("confidence"), "created_at": at, "belief": F.lit("asserted"), "invalid_at": F.lit("")}


def rekey(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges whose start (part of their key) changed: the row of the old key goes, that of the new one comes (src, dst, rel, seq, valid_at, new_valid_at)."""
    key = ["src", "dst", "rel", "seq", "valid_at"]
    moved = edges.join(changes, key).withColumn("valid_at", F.col("new_valid_at")).drop("new_valid_at")
    return edges.join(changes.select(*key), key, "left_anti").unionByName(moved.select(edges.columns))
