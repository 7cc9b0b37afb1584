"""Extractors: what makes entities, tags and relations of texts. Models plug in; those here need none."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import extraction as X
from chronoloom.functions.text import capitalised, clean_tags, plain_tags, sentences, words


def _none() -> Column:
    return F.array().cast("array<string>")


class Extractor(Protocol):
    """Columns of entities and tags for each kind of surface; models may use pandas functions behind them."""

    def text(self, text: Column) -> tuple[Column, Column]: ...

    def image(self, path: Column) -> tuple[Column, Column]: ...

    def url(self, title: Column, body: Column) -> tuple[Column, Column]: ...

    def commit(self, message: Column) -> tuple[Column, Column]: ...

    def repo(self, readme: Column) -> tuple[Column, Column]: ...


class Composed:
    """An extractor of an entity function and a tag function."""

    def __init__(self, entities: Callable[[Column], Column], tags: Callable[[Column], Column]) -> None:
        self.entities, self.tags = entities, tags

    def text(self, text: Column) -> tuple[Column, Column]:
        return self.entities(text), self.tags(text)

    def image(self, path: Column) -> tuple[Column, Column]:
        return _none(), _none()

    def url(self, title: Column, body: Column) -> tuple[Column, Column]:
        return self.text(F.concat_ws("\n", title, body))

    commit = repo = text


def keywords(text: Column, most: int = 14) -> Column:
    return clean_tags(words(text), ["the", "and"], most)


BACKENDS: dict[str, Callable[[], Composed]] = {
    "surface": lambda: Composed(capitalised, plain_tags),
    "keywords": lambda: Composed(keywords, keywords),
    "structure": lambda: Composed(lambda t: _none(), lambda t: _none()),
}
ALIASES = {"mock": "surface", "auto": "surface", "none": "structure"}


def extractor(name: str, **more: Callable[[], Composed]) -> Composed:
    """An extractor by name; ``more`` adds backends, for instance with models."""
    known = {**BACKENDS, **more}
    name = ALIASES.get(name, name)
    if name not in known:
        raise ValueError(f"unknown extractor {name!r}: {', '.join(sorted(known))}")
    return known[name]()


def extract(items: DataFrame, by: Composed) -> DataFrame:
    """id, entities, tags of items (id, kind, title, text): the surface of each kind goes to its function; files give nothing."""
    e, t = by.text(F.col("text"))
    ue, ut = by.url(F.col("title"), F.col("text"))
    link, file = F.col("kind") == "link", F.col("kind") == "file"
    return items.select("id", F.when(file, _none()).when(link, ue).otherwise(e).alias("entities"), F.when(file, _none()).when(link, ut).otherwise(t).alias("tags"))


def scripted(items: DataFrame, table: DataFrame) -> DataFrame:
    """Extractions looked up by text, whatever its case and spaces; an unknown text has none."""
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    known = table.select(key.alias("_k"), "entities").dropDuplicates(["_k"])
    return items.withColumn("_k", key).join(known, "_k", "left").withColumn("entities", F.coalesce("entities", _none())).drop("_k")


def gated(items: DataFrame, floor: Composed, closer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The floor's extraction of all items; items with a cue also go to ``closer`` (id, entities, tags), whose finds come first."""
    base = extract(items, floor).withColumn("escalated", F.lit(False))
    if closer is None:
        return base
    more = closer(items.where(X.has_cue(F.col("text")))).select("id", F.col("entities").alias("_e"), F.col("tags").alias("_t"))
    joined = base.join(more, "id", "left")
    return joined.select("id", X.ordered_union(F.col("_e"), F.col("entities")).alias("entities"), X.ordered_union(F.col("_t"), F.col("tags")).alias("tags"), F.col("_e").isNotNull().alias("escalated"))


def escalation_summary(items: DataFrame) -> DataFrame:
    """How many texts have cues, by kind and in all."""
    kinds = items.select(X.cue_kinds(F.col("text")).alias("k"))
    per = [F.count_if(F.array_contains("k", c)).alias(c) for c in sorted(X.CUES)]
    hit = F.count_if(F.size("k") > 0)
    return kinds.agg(F.count("*").alias("seen"), hit.alias("escalated"), F.round(hit / F.count("*"), 3).alias("rate"), *per)


def dedup_entities(rows: DataFrame) -> DataFrame:
    """The best score of each name of an item (id, name, score), without pronouns, roles and single letters."""
    low = rows.withColumn("name", F.lower(F.trim("name"))).where((F.length("name") >= 2) & ~F.col("name").isin(X.PRONOUNS))
    return low.groupBy("id", "name").agg(F.max("score").alias("score"))


def cooccurrences(items: DataFrame, entities: DataFrame, most: int = 40) -> DataFrame:
    """Neighbouring entities of a sentence, by their first place in it, as relations: one for each directed pair, the first ``most``."""
    s = items.select("id", F.posexplode(sentences(F.col("text"))).alias("line", "sentence"))
    at = s.join(entities, "id").withColumn("at", F.instr(F.lower("sentence"), F.lower(F.col("name")))).where("at > 0")
    order = Window.partitionBy("id", "line").orderBy("at", "name")
    pairs = at.withColumn("other", F.lead("name").over(order)).where("other is not null and other <> name")
    ended = F.lower("sentence").rlike(X.CUES["termination"])
    once = pairs.groupBy("id", F.col("name").alias("src"), F.col("other").alias("dst")).agg(F.min(F.struct("line", "at", ended.alias("ended"))).alias("m"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("m.line", "m.at", "dst"))).where(F.col("n") <= most)
    return ranked.select("id", "src", "dst", F.when(F.col("m.ended"), "ended").otherwise("asserted").alias("status"), F.lit(0.6).alias("confidence"))


def merge_extractions(relations: DataFrame) -> DataFrame:
    """Relations (src, dst, valid_from, label, status, valid_to) as one for each pair and start: all labels, the strongest status, an end if any has one."""
    rank = F.when(F.col("status") == "retracted", 2).when(F.col("status") == "ended", 1).otherwise(0)
    return relations.groupBy(F.lower("src").alias("src"), F.lower("dst").alias("dst"), "valid_from").agg(
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max_by("status", rank).alias("status"), F.max(F.when(F.col("valid_to") != "", F.col("valid_to"))).alias("valid_to")
    )


def payloads(rows: DataFrame, column: str, stop: list[str]) -> DataFrame:
    """Entities, tags and facts of JSON payloads: unknown types become "other", process words and empty names go, facts need a number."""
    schema = "entities array<struct<name string, type string>>, tags array<string>, facts array<struct<subject string, predicate string, value double>>"
    p = rows.withColumn("_p", F.from_json(column, schema))
    types = ["person", "place", "org", "event", "date", "quantity", "product", "concept", "work", "other"]
    kind = lambda t: F.when(F.lower(t) == "term", "concept").when(F.lower(t).isin(types), F.lower(t)).otherwise("other")
    entities = F.filter(F.transform(F.coalesce("_p.entities", F.array()), lambda e: F.struct(F.trim(e["name"]).alias("name"), kind(e["type"]).alias("type"))), lambda e: e["name"] != "")
    tags = F.filter(F.transform(F.coalesce("_p.tags", _none()), lambda t: F.lower(F.trim(t))), lambda t: (t != "") & ~t.isin(stop))
    facts = F.filter(F.coalesce("_p.facts", F.array()), lambda f: (f["subject"] != "") & (f["predicate"] != "") & f["value"].isNotNull())
    return p.withColumns({"entities": entities, "tags": F.array_distinct(tags), "facts": facts}).drop("_p")
