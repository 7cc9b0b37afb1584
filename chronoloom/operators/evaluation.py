"""Evaluation of rankings and runs: totals, series, prices, profiles."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_scores(rows: DataFrame, digits: int = 3) -> DataFrame:
    """Mean recall and reciprocal rank by mode and kind, and by mode overall (kind null)."""
    return rows.rollup("mode", "kind").agg(F.count("*").alias("n"), F.round(F.avg("recall"), digits).alias("recall"), F.round(F.avg("mrr"), digits).alias("mrr")).where("mode is not null")


def score_queries(ranked: DataFrame, gold: DataFrame, k: int, shown: int) -> DataFrame:
    """Precision, recall, best rank and hit of each query with gold at the smaller of k and what the context shows."""
    top = min(k, shown)
    hit = ranked.where(F.col("rank") <= top).join(gold, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best"))
    total = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    size = ranked.where(F.col("rank") <= top).groupBy("query_id").agg(F.count("*").alias("shown"))
    joined = total.join(hit, "query_id", "left").join(size, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.select("query_id", F.round(F.coalesce(F.col("hits") / F.col("shown"), F.lit(0.0)), 3).alias("precision"), F.round(F.col("hits") / F.col("gold"), 3).alias("recall"), "best", (F.col("hits") > 0).alias("hit"))


def lead_words(text: Column, most: int = 12, least: int = 5) -> Column:
    """The first words of a text that say something, as a question; null if there are too few."""
    w = F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), lambda x: x != "")), 1, most)
    return F.when(F.size(w) >= least, F.array_join(w, " "))


def counted(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def summed(rows: DataFrame, by: list[str], measures: list[str], digits: int = 6) -> DataFrame:
    """Calls and sums by site, model or label."""
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), *[F.round(F.sum(m), digits).alias(m) for m in measures])


def footprint(tags: DataFrame, entities: DataFrame, relations: DataFrame, most: tuple[int, int, int] = (14, 16, 8)) -> DataFrame:
    """The first tags, entities and relation labels of each document (doc_id, pos, value)."""

    def first(df: DataFrame, n: int, name: str) -> DataFrame:
        kept = df.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "value"))).where(F.col("_n") <= n)
        return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]), ",").alias(name))

    parts = [first(df, n, name) for df, n, name in zip((tags, entities, relations), most, ("tags", "entities", "relations"), strict=True)]
    return parts[0].join(parts[1], "doc_id", "full").join(parts[2], "doc_id", "full")


def appearances(steps: DataFrame) -> DataFrame:
    """The first step of each node (node, step) and how many steps have it."""
    return steps.groupBy("node").agg(F.min("step").alias("appears"), F.countDistinct("step").alias("n_steps"))


def classified(occurrences: DataFrame, matches: DataFrame) -> DataFrame:
    """Occurrences (query_id, occ) as CAPTURED by their first matching node (query_id, occ, node), COLLAPSED if others have it too, or MISSING."""
    first = matches.groupBy("query_id", "occ").agg(F.min("node").alias("node"))
    claims = first.withColumn("claims", F.count("*").over(Window.partitionBy("query_id", "node")))
    joined = occurrences.join(claims, ["query_id", "occ"], "left")
    return joined.select("query_id", "occ", F.when(F.col("node").isNull(), "MISSING").when(F.col("claims") > 1, "COLLAPSED").otherwise("CAPTURED").alias("state"))


def tier_summary(rows: DataFrame) -> DataFrame:
    """Counts and shares of the states of occurrences, by shape and in all (shape null)."""
    n = F.count("*")
    per = [F.count_if(F.col("state") == s).alias(s.lower()) for s in ("CAPTURED", "COLLAPSED", "MISSING")]
    return rows.rollup("shape").agg(n.alias("n"), *per, F.round(F.count_if(F.col("state") == "CAPTURED") / n, 3).alias("share"))


def deduplicated(occurrences: DataFrame) -> DataFrame:
    """Occurrences (query_id, occ, label) grouped by shared capitalised words, in order; a group's first stays. A query has a handful."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[set] = []
        keep = []
        for label in pdf.sort_values("occ")["label"]:
            own = {w for w in label.split() if w[:1].isupper()}
            home = next((g for g in groups if g & own), None)
            if home is None:
                groups.append(own)
                keep.append(True)
            else:
                home |= own
                keep.append(False)
        return pdf.sort_values("occ")[keep]

    return occurrences.select("query_id", "occ", "label").groupBy("query_id").applyInPandas(run, "query_id long, occ long, label string")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs (id, kind, correct, found) side by side: gains, losses, and why a failure of both stays one."""
    both = a.select("id", "kind", F.col("correct").alias("a")).join(b.select("id", F.col("correct").alias("b"), "found"), "id", "full")
    persistent = F.when(F.col("found") >= 1, "READER").when(F.col("found") > 0, "PARTIAL").otherwise("RETRIEVAL")
    state = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") & F.col("b"), "same").when(~F.col("a") & F.col("b"), "gain").when(F.col("a"), "loss").otherwise(persistent)
    return both.select("id", "kind", state.alias("state"))


def index_upsert(index: DataFrame, run: DataFrame) -> DataFrame:
    """A run index with this run in place of an older one of its id, newest first."""
    return index.join(run.select("run_id"), "run_id", "left_anti").unionByName(run).orderBy(F.desc("at"), "run_id")


class Profile:
    """Seconds and calls by label; profiles add up."""

    def __init__(self) -> None:
        self.spans: dict[str, list[float]] = defaultdict(lambda: [0.0, 0])

    @contextmanager
    def span(self, label: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            s = self.spans[label]
            s[0] += time.perf_counter() - began
            s[1] += 1

    def add(self, other: Profile) -> Profile:
        for label, (seconds, calls) in other.spans.items():
            self.spans[label][0] += seconds
            self.spans[label][1] += calls
        return self
