"""From ranked episodes (query_id, id, rank, ...) to a context: windows in time, seeds, fusion, caps, siblings, rendering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.extraction import surfaces
from chronoloom.functions.keys import surface_key, tokens

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
UNIT_SLACK = {"day": 1, "week": 3, "month": 10, "year": 45}
LAST_SLACK = {"week": 4, "month": 12, "year": 45}
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def _count(word: Column) -> Column:
    n = F.array_position(F.array(*[F.lit(x) for x in NUMBERS]), word)
    return F.when(word.rlike("^[0-9]{1,4}$"), word.cast("int")).when(word.isin("a", "an"), 1).when(n > 0, n.cast("int"))


def days_back(text: Column, anchor: Column) -> Column:
    """What a phrase says about time before the anchor: struct of days, slack and whether it is exact; null without a phrase."""
    low = F.lower(F.coalesce(text, F.lit("")))
    word, unit = (F.regexp_extract(low, r"(^|[^a-z0-9])([0-9]{1,4}|an?|" + "|".join(NUMBERS) + r") (day|week|month|year)s? ago", i) for i in (2, 3))
    last = F.regexp_extract(low, r"(^|[^a-z])last (week|month|year)($|[^a-z])", 2)
    day = F.regexp_extract(low, r"(^|[^a-z])last (" + "|".join(WEEKDAYS) + ")", 2)
    per = lambda table, u: F.coalesce(*[F.when(u == k, v) for k, v in table.items()], F.lit(0))
    target = F.array_position(F.array(*[F.lit(x) for x in WEEKDAYS]), day).cast("int") - 1
    found = lambda days, slack, exact: F.struct(days.cast("int").alias("days"), slack.cast("int").alias("slack"), exact.alias("exact"))
    return (
        F.when(day != "", found(F.pmod(F.weekday(anchor) - target + 6, F.lit(7)) + 1, F.lit(1), F.lit(False)))
        .when(unit != "", found(_count(word) * per(UNIT_DAYS, unit), per(UNIT_SLACK, unit), unit == "day"))
        .when(low.rlike("(^|[^a-z])yesterday($|[^a-z])"), found(F.lit(1), F.lit(0), F.lit(True)))
        .when(last != "", found(per(UNIT_DAYS, last), per(LAST_SLACK, last), F.lit(False)))
    )


def relative_window(text: Column, anchor: Column) -> Column:
    """The days that a phrase means, as struct of first and last; null where it means none or the anchor is null."""
    back = days_back(text, anchor)
    return F.when(back.isNotNull() & anchor.isNotNull(), F.struct(F.date_sub(anchor, back["days"] + back["slack"]).alias("first"), F.date_sub(anchor, back["days"] - back["slack"]).alias("last")))


def annotated(text: Column, anchor: Column) -> Column:
    """The text with the day that its phrase means, marked as exact or about."""
    back = days_back(text, anchor)
    mark = F.when(back["exact"], " [= ").otherwise(" [≈ ")
    return F.when(back.isNull() | anchor.isNull(), text).otherwise(F.concat(text, mark, F.date_sub(anchor, back["days"]).cast("string"), F.lit("]")))


def when_with_delta(day: Column, asked: Column) -> Column:
    """A date with its distance from the question."""
    n = F.datediff(asked, day)
    far = F.concat(F.abs(n).cast("string"), F.when(F.abs(n) == 1, " day ").otherwise(" days "), F.when(n > 0, "before").otherwise("after"), F.lit(" the question"))
    return F.when(day.isNull(), "").when(asked.isNull(), F.concat(F.lit("("), day.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("("), day.cast("string"), F.lit(", "), F.when(n == 0, "same day").otherwise(far), F.lit(")")))


# ---- seeds and candidates


def key_hits(questions: DataFrame, keys: DataFrame, most: int = 3) -> DataFrame:
    """Nodes whose key (key, id) is a run of one to ``most`` words of a question (query_id, text)."""
    asked = questions.select("query_id", F.explode(surfaces(F.col("text"), most)).alias("s")).withColumn("key", surface_key(F.col("s")))
    return asked.select("query_id", "key").distinct().join(keys, "key").select("query_id", "id").distinct()


def fused_seeds(lists: list[tuple[DataFrame, float]], valid: DataFrame) -> DataFrame:
    """The largest weighted score of each seed over lists of (query_id, id, score); ids that aren't valid go."""
    every = None
    for df, weight in lists:
        part = df.select("query_id", "id", (F.col("score") * weight).alias("score"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", "id").agg(F.max("score").alias("score")).join(valid.select("id"), "id", "left_semi")


def boosted(candidates: DataFrame, far: int = 6) -> DataFrame:
    """Candidates (score, dist) by score x (1 + 1 / (1 + distance)); an unknown distance counts as ``far``."""
    base = F.col("score") * (1 + 1 / (1 + F.coalesce("dist", F.lit(far))))
    ranked = candidates.withColumn("base", F.round(base, 6))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "id")))


def mmr(candidates: DataFrame, k: int, weight: float) -> DataFrame:
    """Greedy choice of k of each query's candidates (query_id, id, base, vec): weight x base less (1 - weight) x the largest cosine to what is chosen. Ties keep the pool's order (base, id). A query's pool is small: it was cut to a few times k."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["base", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.array(pdf["vec"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near, left, out = np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(out) < k:
            score = [weight * pdf["base"][i] - (1 - weight) * (near[i] if out else 0.0) for i in left]
            best = left.pop(int(np.argmax(score)))
            out.append(best)
            near = np.maximum(near, v @ v[best]) if len(out) > 1 else v @ v[best]
        chosen = pdf.iloc[out][["query_id", "id", "base"]].copy()
        chosen["rank"] = range(1, len(out) + 1)
        return chosen

    kind = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, id {kind['id']}, base double, rank int")


def augmented(pool: DataFrame, more: DataFrame) -> DataFrame:
    """The pool (query_id, id, rank), then what else (query_id, id) there is, in order of id."""
    new = more.select("query_id", "id").distinct().join(pool, ["query_id", "id"], "left_anti")
    last = pool.groupBy("query_id").agg(F.max("rank").alias("_m"))
    placed = new.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).join(last, "query_id", "left")
    return pool.select("query_id", "id", "rank").unionByName(placed.select("query_id", "id", (F.coalesce("_m", F.lit(0)) + F.col("_n")).cast("int").alias("rank")))


def guaranteed(ranked: DataFrame, first: DataFrame, k: int, top: int = 3) -> DataFrame:
    """The k first of a ranking, its tail giving way to the ``top`` best of another that it lacks."""
    kept = ranked.where(F.col("rank") <= k)
    missing = first.where(F.col("rank") <= top).join(kept, ["query_id", "id"], "left_anti").select("query_id", "id", F.col("rank").alias("_r"))
    n = missing.groupBy("query_id").agg(F.count("*").alias("_n"))
    wanted = first.where(F.col("rank") <= top).select("query_id", "id").withColumn("_w", F.lit(True))
    plain = kept.join(n, "query_id", "left").join(wanted, ["query_id", "id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    # the last that aren't wanted themselves give way
    back = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_w").isNotNull(), F.desc("rank")))
    stay = plain.withColumn("_b", back).where(F.col("_w").isNotNull() | (F.col("_b") > F.col("_n"))).select("query_id", "id", F.struct(F.lit(0).alias("from"), F.col("rank").alias("at")).alias("_o"))
    every = stay.unionByName(missing.select("query_id", "id", F.struct(F.lit(1).alias("from"), F.col("_r").alias("at")).alias("_o")))
    return every.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("_o")).alias("rank"))


def sessions_first(ranked: DataFrame, session: str, k: int) -> DataFrame:
    """A permutation: the first of each session fill the first k places, all others follow in order."""
    own = F.row_number().over(Window.partitionBy("query_id", session).orderBy("rank"))
    first = ranked.withColumn("_s", own == 1)
    lead = first.withColumn("_l", F.col("_s") & (F.sum(F.col("_s").cast("int")).over(Window.partitionBy("query_id").orderBy("rank")) <= k))
    return lead.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_l"), "rank"))).drop("_s", "_l")


def reserved(ranked: DataFrame, extra: DataFrame, session: str, k: int, most: int = 2) -> DataFrame:
    """The k first, the last of them giving way to at most ``most`` extra rows (query_id, id, session, rank) of sessions not covered."""
    top = ranked.where(F.col("rank") <= k)
    new = extra.join(top.select("query_id", session).distinct(), ["query_id", session], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("_n") <= most)
    n = new.groupBy("query_id").agg(F.count("*").alias("_c"))
    stay = top.join(n, "query_id", "left").where(F.col("rank") <= k - F.coalesce("_c", F.lit(0))).select("query_id", "id", F.col("rank").cast("int").alias("rank"))
    return stay.unionByName(new.join(n, "query_id").select("query_id", "id", (k - F.col("_c") + F.col("_n")).cast("int").alias("rank")))


def in_window(rows: DataFrame, day: str, since: str | None, until: str | None) -> DataFrame:
    """Rows whose ten first characters of the date lie between the bounds, both included; rows without a date go."""
    d = F.substring(day, 1, 10)
    out = rows.where(d != "")
    out = out.where(d >= since) if since else out
    return out.where(d <= until) if until else out


def reranked(items: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Items by a scorer (items to query_id, id, ce); without one, or where it gives nothing, the order stays."""
    if score is None:
        return items
    scored = items.join(score(items), ["query_id", "id"], "left")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("ce"), "rank"))).drop("ce")


def hybrid(pool: DataFrame, lanes: DataFrame, episodes: DataFrame, fact_episodes: DataFrame, k: int, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The retrieval path: a diffusion pool (query_id, id, rank); state questions add episodes of facts; questions of recent things go by
    time; state and multihop questions are reranked; the three best of the pool stay; the k first get scores k, k - 1, ..."""
    state = lanes.where("lane = 'state'").select("query_id")
    wide = augmented(pool, fact_episodes.join(state, "query_id", "left_semi"))
    dated = wide.join(episodes.select("id", "day"), "id").join(lanes, "query_id")
    recent = dated.where("lane = 'recency'").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("day"), "rank")).cast("int")).where(F.col("rank") <= max(2 * k, k))
    close = reranked(dated.where("lane in ('state', 'multihop')").select("query_id", "id", "rank"), rerank).select("query_id", "id", F.col("rank").cast("int").alias("rank"))
    plain = dated.where("lane = 'single'").select("query_id", "id", "rank")
    ranked = recent.select("query_id", "id", "rank").unionByName(close).unionByName(plain)
    best = guaranteed(ranked, pool, k)
    size = Window.partitionBy("query_id")
    return best.withColumn("score", (F.count("*").over(size) - F.col("rank") + 1).cast("double"))


# ---- context


def payload_bonus(text: Column) -> Column:
    """How much a passage looks like an answer: dates, money, numbers."""
    low = F.lower(F.coalesce(text, F.lit("")))
    on = lambda rule, n: F.when(low.rlike(rule), n).otherwise(0)
    return (
        on(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", 4) + on(r"[$€£] ?[0-9]|[0-9] ?(dollars|euros|pounds)", 3) + on("[0-9]", 1)
        + on(r"yesterday|tomorrow|(last|next) (week|month|year)|[0-9]+ (days|weeks|months|years) ago", 4) + on("(^|[^a-z])(" + "|".join(NUMBERS[1:]) + ") [a-z]", 3)
    )


def lexical_score(text: Column, terms: Column) -> Column:
    """Terms in common, numbers three times more, and the bonus."""
    own = F.array_distinct(tokens(F.coalesce(text, F.lit(""))))
    common = F.array_intersect(own, terms)
    digits = F.size(F.filter(common, lambda t: t.rlike("^[0-9]+$")))
    return F.size(common) + 2 * digits + payload_bonus(text)


def siblings(selected: DataFrame, chunks: DataFrame, span: int = 2, budget: int = 60000) -> DataFrame:
    """Chunks (base, ord, size) within ``span`` places of selected ones (query_id, base, ord, rank), taken in rank order while their sizes fit the budget."""
    near = selected.select("query_id", "base", F.col("ord").alias("_o"), "rank").join(chunks, "base").where(F.abs(F.col("ord") - F.col("_o")) <= span)
    once = near.groupBy("query_id", "base", "ord").agg(F.min(F.struct("rank", F.abs(F.col("ord") - F.col("_o")).alias("d"))).alias("m"), F.first("size").alias("size"))
    used = F.sum("size").over(Window.partitionBy("query_id").orderBy("m.rank", "m.d", "base", "ord").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("used", used).where(F.col("used") <= budget).select("query_id", "base", "ord", "used")


def retargeted(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """As many chunks of each source as were selected, but the best by score (query_id, base, ord, score), incumbents first among equals; in order of the source's best rank and of place."""
    slots = selected.groupBy("query_id", "base").agg(F.count("*").alias("_n"), F.min("rank").alias("_r"))
    kept = selected.select("query_id", "base", "ord").withColumn("_i", F.lit(1))
    scored = chunks.join(slots, ["query_id", "base"]).join(kept, ["query_id", "base", "ord"], "left")
    best = scored.withColumn("_p", F.row_number().over(Window.partitionBy("query_id", "base").orderBy(F.desc("score"), F.desc_nulls_last("_i"), "ord"))).where("_p <= _n")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "base", "ord"))).select("query_id", "base", "ord", "place")


def promoted(context: DataFrame, sources: DataFrame) -> DataFrame:
    """A context (query_id, id, place, expanded) whose last expansion gives way to the first chunk (query_id, id, rank) a matching fact came from, if it isn't there."""
    new = sources.join(context, ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.min_by("id", "rank").alias("_new"))
    last = context.where("expanded").groupBy("query_id").agg(F.max("place").alias("_at"))
    swap = context.join(new.join(last, "query_id"), "query_id", "left")
    return swap.select("query_id", F.when(F.col("place") == F.col("_at"), F.col("_new")).otherwise(F.col("id")).alias("id"), "place")


def blob(questions: DataFrame, episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """The text for an answerer: question, date, episodes (query_id, place, line) and facts (query_id, place, line) in order."""

    def lines(df: DataFrame, name: str) -> DataFrame:
        rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
        return df.groupBy("query_id").agg(F.array_join(rows, "\n").alias(name))

    q = questions.join(lines(episodes, "_e"), "query_id", "left").join(lines(facts, "_f"), "query_id", "left")
    part = lambda head, body: F.when(F.col(body).isNotNull(), F.concat(F.lit(f"\n\n{head}\n"), F.col(body))).otherwise("")
    return q.select("query_id", F.concat(F.lit("QUESTION: "), "text", F.lit("\nAS OF: "), "day", part("EPISODES", "_e"), part("FACTS", "_f")).alias("context"))


def relevant_entities(seeds: DataFrame, star: DataFrame, episodes: DataFrame) -> DataFrame:
    """Entities among a question's seeds and of its episodes (query_id, id), each once."""
    of = episodes.select("query_id", F.col("id").alias("episode_id")).join(star, "episode_id").select("query_id", F.col("entity_id").alias("id"))
    return seeds.where("id like 'entity_%'").select("query_id", "id").unionByName(of).distinct()


# ---- answers without a model


def extractive(facts: Column, episodes: Column, lead: int = 220) -> Column:
    """An answer from what was found: its facts, then the beginnings of its episodes."""
    return F.array_join(F.concat(facts, F.transform(episodes, lambda t: F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, lead))), "\n")


def citations(raw: Column, known: Column) -> Column:
    """Which cited ids are in the context, each once in order, and which aren't."""
    return F.struct(F.array_intersect(F.array_distinct(raw), known).alias("kept"), F.array_except(F.array_distinct(raw), known).alias("dropped"))


def without_citations(text: Column) -> Column:
    """A text without bracketed episode ids, and without the gaps that they leave."""
    bare = F.regexp_replace(text, r"\s*[\[(]\s*ep_[A-Za-z0-9_#]+(\s*[,;]\s*ep_[A-Za-z0-9_#]+)*\s*[\])]", "")
    return F.trim(F.regexp_replace(bare, r"\s+([.,;])", "$1"))


def answer_shape(lane: Column) -> Column:
    return F.when(lane.isin("multihop", "state"), "events").otherwise("plain")
