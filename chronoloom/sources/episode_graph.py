"""The documents as an episode graph: episodes, entities by surface, tags, mentions, facts between neighbouring entities.

Ids come from content, so no row depends on another's arrival: ``ep_<doc>``, ``men_<doc>_<place>``, ``entity_<surface>``, ``tag_<tag>``,
``src_<source>``. Dates, validity and belief follow from the doc_id by fixed rules, since documents have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.sources.tables import table

_WORDS = "[x FOR x IN string_split_regex(coalesce({0}, ''), '[^\\p{{L}}\\p{{N}}_]+') IF x <> '']"

#: The same views in SQL, as common table expressions.
GRAPH_SQL = f"""ep AS (SELECT doc_id, 'ep_' || doc_id AS id, coalesce(text, '') AS text, lang, source, strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') AS day, doc_id % 11 <> 0 AS valid FROM documents),
 en AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS pos FROM (SELECT doc_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, [lower(x) FOR x IN {_WORDS.format("text")} IF regexp_full_match(x, '[A-Z][a-z][a-z]+')] AS l FROM documents)) GROUP BY doc_id, name QUALIFY pos <= 8),
 tg AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS pos FROM (SELECT doc_id, unnest(l) AS tag, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, [x FOR x IN {_WORDS.format("lower(text)")} IF regexp_full_match(x, '[a-z]{{5,}}')] AS l FROM documents)) GROUP BY doc_id, tag QUALIFY pos <= 3),
 fx AS (SELECT a.doc_id, 'entity_' || a.name AS src, CASE a.pos % 3 WHEN 0 THEN 'knows' WHEN 1 THEN 'works_at' ELSE 'related_to' END AS rel, 'entity_' || b.name AS dst, ep.day AS valid_at, CASE WHEN a.doc_id % 3 = 0 THEN strftime(ep.day::DATE + 10, '%Y-%m-%d') ELSE '' END AS invalid_at, CASE WHEN a.doc_id % 7 = 0 THEN 'retracted' ELSE 'asserted' END AS belief, ep.id AS episode_id, 0.6::DOUBLE AS confidence, a.doc_id * 10 + a.pos AS seq FROM en a JOIN en b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN ep ON ep.doc_id = a.doc_id),
 ty AS (SELECT DISTINCT 'entity_' || name AS id, name, CASE length(name) % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'place' WHEN 2 THEN 'org' ELSE 'concept' END AS entity_type FROM en),
 nd AS (SELECT id, 'episode' AS ntype, left(text, 40) AS name, valid FROM ep UNION ALL SELECT id, 'entity', name, true FROM ty UNION ALL SELECT DISTINCT 'tag_' || tag, 'tag', tag, true FROM tg UNION ALL SELECT DISTINCT 'src_' || source, 'source', source, true FROM ep UNION ALL SELECT 'men_' || doc_id || '_' || pos, 'mention', name, true FROM en),
 ed AS (SELECT 'ep_' || doc_id AS src, 'tag_' || tag AS dst, 'TAGGED_AS' AS etype, '' AS rel, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS weight, 'ep_' || doc_id AS episode_id FROM tg UNION ALL SELECT 'men_' || doc_id || '_' || pos, 'ep_' || doc_id, 'MENTIONED_IN', '', 1.0, 1.0, 'ep_' || doc_id FROM en
  UNION ALL SELECT 'men_' || doc_id || '_' || pos, 'entity_' || name, 'RESOLVES_TO', '', 1.0, 1.0, '' FROM en UNION ALL SELECT src, dst, 'RELATED_TO', rel, confidence, confidence, episode_id FROM fx UNION ALL SELECT id, 'src_' || source, 'PART_OF', '', 1.0, 0.3, id FROM ep
  UNION ALL SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY source ORDER BY doc_id) AS dst, 'NEXT' AS etype, '' AS rel, 1.0 AS confidence, 0.5 AS weight, id AS episode_id FROM ep) WHERE dst IS NOT NULL)"""


def episodes(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("ep_"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", day.alias("day"), (F.col("doc_id") % 11 != 0).alias("valid"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, name, pos from 1: the first eight capitalised surfaces of each document."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.capitalised(F.col("text"))).alias("p", "name")).select("doc_id", "name", (F.col("p") + 1).cast("long").alias("pos"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.plain_tags(F.col("text"))).alias("p", "tag")).select("doc_id", "tag", (F.col("p") + 1).cast("long").alias("pos"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring entities of a document as facts, with validity windows as ISO texts."""
    en = entities(spark, d)
    named = en.withColumn("next", F.lead("name").over(Window.partitionBy("doc_id").orderBy("pos"))).where("next is not null")
    joined = named.join(episodes(spark, d).select("doc_id", "id", "day"), "doc_id")
    rel = F.when(F.col("pos") % 3 == 0, "knows").when(F.col("pos") % 3 == 1, "works_at").otherwise("related_to")
    end = F.when(F.col("doc_id") % 3 == 0, F.date_format(F.date_add(F.col("day").cast("date"), 10), "yyyy-MM-dd")).otherwise("")
    belief = F.when(F.col("doc_id") % 7 == 0, "retracted").otherwise("asserted")
    return joined.select(
        "doc_id", F.concat(F.lit("entity_"), "name").alias("src"), rel.alias("rel"), F.concat(F.lit("entity_"), "next").alias("dst"), F.col("day").alias("valid_at"),
        end.alias("invalid_at"), belief.alias("belief"), F.col("id").alias("episode_id"), F.lit(0.6).alias("confidence"), (F.col("doc_id") * 10 + F.col("pos")).alias("seq"),
    )


def entity_types(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("name") % 4
    kind = F.when(n == 0, "person").when(n == 1, "place").when(n == 2, "org").otherwise("concept")
    return entities(spark, d).select("name").distinct().select(F.concat(F.lit("entity_"), "name").alias("id"), "name", kind.alias("entity_type"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, ntype, name, valid."""
    ep, en, tg = episodes(spark, d), entities(spark, d), tags(spark, d)
    yes = F.lit(True).alias("valid")
    return (
        ep.select("id", F.lit("episode").alias("ntype"), F.substring("text", 1, 40).alias("name"), "valid")
        .unionByName(entity_types(spark, d).select("id", F.lit("entity").alias("ntype"), "name", yes))
        .unionByName(tg.select("tag").distinct().select(F.concat(F.lit("tag_"), "tag").alias("id"), F.lit("tag").alias("ntype"), F.col("tag").alias("name"), yes))
        .unionByName(ep.select("source").distinct().select(F.concat(F.lit("src_"), "source").alias("id"), F.lit("source").alias("ntype"), F.col("source").alias("name"), yes))
        .unionByName(en.select(mention_id().alias("id"), F.lit("mention").alias("ntype"), "name", yes))
    )


def mention_id():
    return F.concat(F.lit("men_"), "doc_id", F.lit("_"), "pos")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, etype, rel, confidence, weight, episode_id of all edge types."""
    ep, en, tg = episodes(spark, d), entities(spark, d), tags(spark, d)
    owner = F.concat(F.lit("ep_"), "doc_id")

    def edge(df: DataFrame, src, dst, etype: str, rel, confidence, weight, episode) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(etype).alias("etype"), rel.alias("rel"), confidence.alias("confidence"), weight.alias("weight"), episode.alias("episode_id"))

    one, none = F.lit(1.0), F.lit("")
    following = ep.withColumn("next", F.lead("id").over(Window.partitionBy("source").orderBy("doc_id"))).where("next is not null")
    return (
        edge(tg, owner, F.concat(F.lit("tag_"), "tag"), "TAGGED_AS", none, one, one, owner)
        .unionByName(edge(en, mention_id(), owner, "MENTIONED_IN", none, one, one, owner))
        .unionByName(edge(en, mention_id(), F.concat(F.lit("entity_"), "name"), "RESOLVES_TO", none, one, one, none))
        .unionByName(edge(facts(spark, d), F.col("src"), F.col("dst"), "RELATED_TO", F.col("rel"), F.col("confidence"), F.col("confidence"), F.col("episode_id")))
        .unionByName(edge(ep, F.col("id"), F.concat(F.lit("src_"), "source"), "PART_OF", none, one, F.lit(0.3), F.col("id")))
        .unionByName(edge(following, F.col("id"), F.col("next"), "NEXT", none, one, F.lit(0.5), F.col("id")))
    )
