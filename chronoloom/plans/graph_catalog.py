"""Queries on the episode graph: storing, deriving, reading and erasing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import graph as G
from chronoloom.operators import graph_store as GS
from chronoloom.plans.registry import query
from chronoloom.sources import episode_graph as EG
from chronoloom.sources.episode_graph import GRAPH_SQL
from chronoloom.sources.tables import table

W = f"WITH {GRAPH_SQL}"

# ---- storing


@query(f"{W}, b AS (SELECT id, name, 0 AS batch FROM nd WHERE ntype = 'tag' UNION ALL SELECT id, upper(name), 1 FROM nd WHERE ntype = 'tag' AND length(name) = 6 UNION ALL SELECT 'tag_' || name || '_new', name, 1 FROM nd WHERE ntype = 'tag' AND length(name) = 7) SELECT id, arg_max(name, batch) AS name FROM b GROUP BY id")
def g01_add_node(spark, d):
    base = GS.nodes_of_type(EG.nodes(spark, d), "tag").select("id", "name")
    changed = base.where("length(name) = 6").select("id", F.upper("name").alias("name"))
    added = base.where("length(name) = 7").select(F.concat(F.lit("tag_"), "name", F.lit("_new")).alias("id"), "name")
    return GS.add_nodes(base, changed.unionByName(added))


@query(f"{W} SELECT src, dst, etype, count(*) AS n FROM ed WHERE src NOT IN (SELECT id FROM ep WHERE doc_id % 4 = 0) AND dst NOT IN (SELECT id FROM ep WHERE doc_id % 4 = 0) GROUP BY ALL")
def g02_remove_node(spark, d):
    gone = EG.episodes(spark, d).where("doc_id % 4 = 0").select("id")
    _, left = GS.remove_nodes(EG.nodes(spark, d), EG.edges(spark, d), gone)
    return left.groupBy("src", "dst", "etype").agg(F.count("*").alias("n"))


@query(f"{W} SELECT src, dst, concat_ws('|', 'RELATED_TO', rel, valid_at, seq::VARCHAR) AS key FROM fx")
def g04_edge_key(spark, d):
    return EG.facts(spark, d).select("src", "dst", GS.edge_key(F.lit("RELATED_TO"), F.col("rel"), F.col("valid_at"), F.col("seq")).alias("key"))


@query(f"{W} SELECT src, dst, string_agg(DISTINCT rel, ',' ORDER BY rel) AS rels FROM fx GROUP BY src, dst")
def g06_pair_relations(spark, d):
    return GS.pair_relations(EG.facts(spark, d))


@query(f"{W} SELECT id, name FROM nd WHERE ntype = 'episode' AND valid")
def g07_nodes_of_type(spark, d):
    return GS.nodes_of_type(EG.nodes(spark, d), "episode").select("id", "name")


@query(f"{W} SELECT count(*) AS n FROM ep WHERE valid")
def g08_episode_count(spark, d):
    return GS.nodes_of_type(EG.nodes(spark, d), "episode").agg(F.count("*").alias("n"))


@query(f"{W} SELECT etype, count(*) AS n, round(sum(confidence * weight), 4) AS strength FROM ed GROUP BY etype")
def g11_edge_scan(spark, d):
    return EG.edges(spark, d).groupBy("etype").agg(F.count("*").alias("n"), F.round(F.sum(F.col("confidence") * F.col("weight")), 4).alias("strength"))


@query(f"{W} SELECT id, ntype, valid AND id NOT IN (SELECT id FROM ep WHERE doc_id % 6 = 1) AS valid FROM nd")
def g12_soft_invalidation(spark, d):
    return GS.invalidate(EG.nodes(spark, d), EG.episodes(spark, d).where("doc_id % 6 = 1").select("id")).select("id", "ntype", "valid")


@query(f"{W}, r AS (SELECT doc_id, src, dst, unnest(['knows', 'likes', 'meets', 'sees']) AS label, generate_subscripts(['knows', 'likes', 'meets', 'sees'], 1) AS n, confidence * (pos % 7) / 6 AS confidence FROM (SELECT fx.*, seq % 10 AS pos FROM fx)) SELECT doc_id, src, dst, label, round(confidence, 6) AS confidence FROM r WHERE confidence >= 0.1 AND src <> dst AND n <= 3")
def g18_relation_rows(spark, d):
    f = EG.facts(spark, d)
    made = f.withColumns({"labels": F.array(*[F.lit(x) for x in ("knows", "likes", "meets", "sees")]), "confidence": F.col("confidence") * (F.col("seq") % 10 % 7) / 6})
    return GS.relation_rows(made).select("doc_id", "src", "dst", "label", F.round("confidence", 6).alias("confidence"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE md5(html) END AS raw FROM pages")
def g19_raw_text_repair(spark, d):
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, F.md5("html")).alias("raw"), F.col("url").alias("source_ref"))
    return p.select("page_id", GS.repaired(F.col("raw"), F.col("source_ref")).alias("raw"))


@query(f"{W}, l AS (SELECT id AS episode_id, day, text, 'm' || doc_id AS path FROM ep WHERE doc_id % 2 = 0), t AS (SELECT day, text, min(path) AS path FROM l GROUP BY ALL) SELECT ep.id, coalesce(a.path, t.path) AS media FROM ep LEFT JOIN l a ON a.episode_id = ep.id LEFT JOIN t ON t.day = ep.day AND t.text = ep.text")
def g20_media_repair(spark, d):
    ep = EG.episodes(spark, d)
    ledger = ep.where("doc_id % 2 = 0").select(F.col("id").alias("episode_id"), "day", "text", F.concat(F.lit("m"), "doc_id").alias("path"))
    return GS.media_paths(ep, ledger)


@query(f"{W}, w AS (SELECT DISTINCT doc_id, lower(trim(tag)) AS tag FROM tg) SELECT 'ep_' || doc_id AS src, 'tag_' || tag AS dst, count(*) OVER (PARTITION BY tag) AS df FROM w")
def g21_tag_wiring(spark, d):
    return GS.wire_tags(EG.tags(spark, d).select(F.concat(F.lit("ep_"), "doc_id").alias("episode_id"), F.concat(F.lit(" "), F.upper("tag")).alias("tag")))


@query(f"{W}, k AS (SELECT DISTINCT 'ep_' || a.doc_id AS src, 'ep_' || b.doc_id AS dst FROM tg a JOIN (SELECT tag, min(doc_id) AS doc_id FROM tg WHERE pos = 1 GROUP BY tag) b USING (tag) WHERE a.doc_id <> b.doc_id) SELECT src, dst, 'HYPERLINKS_TO' AS etype FROM k")
def g22_link_wiring(spark, d):
    tg = EG.tags(spark, d)
    names = tg.where("pos = 1").groupBy(F.col("tag").alias("target")).agg(F.min("doc_id").alias("doc")).select("target", F.concat(F.lit("ep_"), "doc").alias("dst"))
    links = tg.select(F.concat(F.lit("ep_"), "doc_id").alias("src"), F.col("tag").alias("target"))
    return GS.wire_links(links, names)


@query("WITH v AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS version FROM documents) SELECT source, CASE WHEN max(version) = 0 THEN source ELSE source || '_v' || max(version) END AS latest FROM v GROUP BY source")
def g23_latest_version(spark, d):
    v = table(spark, d, "documents").select("source", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("version"))
    return GS.latest_versions(v.select(F.col("source").alias("base"), "version")).select(F.col("base").alias("source"), "latest")


# ---- derived edges


@query(f"{W}, m AS (SELECT tag AS hub, 'ep_' || doc_id AS member, day AS seen FROM tg JOIN ep USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY seen DESC, member DESC) AS n FROM m) SELECT hub, member FROM r WHERE n <= 5")
def d02_hub_cap(spark, d):
    m = EG.tags(spark, d).join(EG.episodes(spark, d).select("doc_id", "day"), "doc_id").select(F.col("tag").alias("hub"), F.concat(F.lit("ep_"), "doc_id").alias("member"), F.col("day").alias("seen"))
    return GS.latest_members(m, 5)


@query(f"{W} SELECT DISTINCT 'ep_' || doc_id AS episode_id, 'entity_' || name AS hub FROM en UNION SELECT 'ep_' || doc_id, 'tag_' || tag FROM tg")
def d03_episode_hubs(spark, d):
    return GS.episode_hubs(EG.edges(spark, d))


@query(f"{W}, t AS (SELECT least(a.doc_id, b.doc_id) AS x, greatest(a.doc_id, b.doc_id) AS y, 'SHARED_TAG' AS etype, 0.5 AS w FROM tg a JOIN tg b ON a.tag = b.tag AND a.doc_id < b.doc_id UNION ALL SELECT least(a.doc_id, b.doc_id), greatest(a.doc_id, b.doc_id), 'SHARED_ENTITY', 0.25 FROM en a JOIN en b ON a.name = b.name AND a.doc_id < b.doc_id) SELECT x AS src, y AS dst, round(sum(w), 4) AS weight, string_agg(DISTINCT etype, ',' ORDER BY etype) AS etypes FROM t GROUP BY x, y")
def d05_object_graph(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.plain_tags(F.col("text")).alias("SHARED_TAG"), X.capitalised(F.col("text")).alias("SHARED_ENTITY"))
    return GS.object_graph(docs, {"SHARED_TAG": 0.5, "SHARED_ENTITY": 0.25})


# ---- lexical documents and fallbacks


@query(f"{W}, e AS (SELECT doc_id, string_agg(name, ' ' ORDER BY name) AS names FROM en GROUP BY doc_id), t AS (SELECT doc_id, string_agg(tag, ' ' ORDER BY pos) AS tags FROM tg GROUP BY doc_id) SELECT ep.id, md5(concat_ws(' ', ep.text, ep.source, t.tags, e.names)) AS doc FROM ep LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id)")
def l01_composite_document(spark, d):
    names = EG.entities(spark, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("names"))
    tags = EG.tags(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda t: t["tag"]), " ").alias("tags"))
    ep = EG.episodes(spark, d).join(names, "doc_id", "left").join(tags, "doc_id", "left")
    return ep.select("id", F.md5(GS.composite_document("text", "source", "tags", "names")).alias("doc"))


@query("WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ask FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), a AS (SELECT item_id, unnest(ask) AS t FROM q), s AS (SELECT item_id, doc_id, count(*) AS score FROM a JOIN w USING (t) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5")
def l04_overlap_fallback(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return GS.overlap_search(docs, q, 5).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


# ---- reading


@query(f"{W}, s AS (SELECT src, rel, dst, valid_at, invalid_at, seq FROM fx WHERE belief = 'asserted'), b AS (SELECT src AS entity, * FROM s UNION ALL SELECT dst, * FROM s), o AS (SELECT entity, src, rel, dst, valid_at, min(seq) AS seq FROM b WHERE NOT (valid_at > '2024-01-15') AND NOT (invalid_at <> '' AND invalid_at <= '2024-01-15') GROUP BY entity, src, rel, dst, valid_at), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS n FROM o) SELECT entity, src, rel, dst, valid_at FROM r WHERE n <= 30")
def t19_facts_for_entities(spark, d):
    return GS.facts_for(EG.facts(spark, d), "2024-01-15", 30)


@query(f"{W}, b AS (SELECT src AS entity, * FROM fx UNION ALL SELECT dst, * FROM fx) SELECT DISTINCT entity, src, rel, dst, valid_at, invalid_at, CASE WHEN invalid_at = '' THEN 'active' ELSE 'closed' END AS status FROM b WHERE belief = 'asserted'")
def t20_entity_fact_rows(spark, d):
    return GS.entity_fact_rows(EG.facts(spark, d), None, include_closed=True)


@query(f"{W} SELECT fx.seq, coalesce(a.name, fx.src) || ' --' || coalesce(nullif(fx.rel, ''), 'related_to') || '--> ' || coalesce(b.name, fx.dst) AS line FROM fx LEFT JOIN ty a ON a.id = fx.src AND a.entity_type <> 'org' LEFT JOIN ty b ON b.id = fx.dst AND b.entity_type <> 'org'")
def t22_named_fact(spark, d):
    names = EG.entity_types(spark, d).where("entity_type <> 'org'").select("id", "name")
    return GS.named_facts(EG.facts(spark, d), names).select("seq", "line")


@query(f"{W} SELECT seq FROM fx WHERE belief = 'asserted'")
def t23_believed(spark, d):
    return EG.facts(spark, d).where(GS.believed()).select("seq")


@query(f"{W}, s AS (SELECT DISTINCT src, dst FROM ed WHERE etype = 'TAGGED_AS') SELECT id, name, coalesce(n, 0) AS n FROM nd LEFT JOIN (SELECT dst AS id, count(*) AS n FROM s GROUP BY dst) USING (id) WHERE ntype = 'tag'")
def q02_tag_usage(spark, d):
    used = EG.edges(spark, d).where("etype = 'TAGGED_AS'").select("src", F.col("dst").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("n"))
    return GS.nodes_of_type(EG.nodes(spark, d), "tag").select("id", "name").join(used, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"{W}, q AS (SELECT conv_id, turn, lower(split_part(trim(text), ' ', 1)) AS s FROM conversations), k AS (SELECT name AS s, 0 AS prio, id FROM ty UNION ALL SELECT name, 1, id FROM nd WHERE ntype = 'tag'), b AS (SELECT s, arg_min(id, prio) AS id FROM k GROUP BY s) SELECT conv_id, turn, id, id IS NOT NULL AS resolved FROM q LEFT JOIN b USING (s)")
def q06_surface_resolve(spark, d):
    asked = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.trim("text"), " ")[0].alias("surface"))
    return GS.resolve_surfaces(asked, GS.surface_keys(EG.nodes(spark, d))).select("conv_id", "turn", "id", "resolved")


@query(f"{W}, r AS (SELECT src, rel, dst, valid_at, seq, row_number() OVER (PARTITION BY src ORDER BY valid_at DESC, seq DESC) AS n FROM fx WHERE belief = 'asserted' AND invalid_at = '') SELECT src, rel, dst, valid_at, row_number() OVER (PARTITION BY src ORDER BY valid_at, seq) AS place FROM r WHERE n <= 12")
def q07_profile_facts(spark, d):
    return GS.profile_facts(EG.facts(spark, d), 12)


@query(f"{W}, v AS (SELECT entity_type, name, count(DISTINCT doc_id) AS df FROM ty JOIN en USING (name) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY df DESC, name) AS place FROM v) SELECT entity_type, name, df, place FROM r WHERE place <= 10")
def q08_vocabulary(spark, d):
    en = EG.entities(spark, d).join(EG.entity_types(spark, d).select("name", "entity_type"), "name")
    return GS.vocabulary(en.select("entity_type", "name", "doc_id"), 10)


@query(f"{W} SELECT ep.id, ep.day, 'src_' || ep.source AS source_id, md5(ep.text) AS body FROM ep WHERE valid")
def q09_episode(spark, d):
    ep = EG.episodes(spark, d)
    return GS.episode_cards(ep, EG.edges(spark, d)).select("id", "day", "source_id", F.md5("text").alias("body"))


@query(f"{W}, s AS (SELECT DISTINCT doc_id, 'entity_' || name AS id FROM en WHERE pos <= 3) SELECT DISTINCT fx.episode_id, src, rel, dst FROM fx JOIN s ON s.doc_id = fx.doc_id AND (s.id = src OR s.id = dst) WHERE belief = 'asserted'")
def q10_grounded_facts(spark, d):
    seeds = EG.entities(spark, d).where("pos <= 3").select(F.concat(F.lit("ep_"), "doc_id").alias("episode_id"), F.concat(F.lit("entity_"), "name").alias("id"))
    return GS.grounded_facts(EG.facts(spark, d), seeds)


@query(f"{W} SELECT DISTINCT 'ep_' || doc_id AS episode_id, name, CASE WHEN entity_type IN ('person', 'place') THEN entity_type ELSE 'thing' END AS category FROM en JOIN ty USING (name)")
def q11_episode_entities(spark, d):
    return GS.episode_entities(EG.edges(spark, d), EG.entity_types(spark, d))


@query(f"{W}, m AS (SELECT 'ep_' || doc_id AS a, 'entity_' || name AS b FROM en) SELECT DISTINCT a AS node, b AS neighbour FROM m UNION SELECT b, a FROM m UNION SELECT src, dst FROM fx WHERE belief = 'asserted' UNION SELECT dst, src FROM fx WHERE belief = 'asserted'")
def q13_display_neighbours(spark, d):
    return GS.display_neighbours(EG.edges(spark, d), EG.facts(spark, d))


@query(f"{W} SELECT episode_id, count(DISTINCT x) AS n_nodes, count(DISTINCT src || dst) AS n_pairs FROM (SELECT episode_id, src, dst, unnest([src, dst]) AS x FROM fx WHERE belief = 'asserted') GROUP BY episode_id")
def q14_episode_graph(spark, d):
    return GS.episode_graph(EG.facts(spark, d))


@query(f"{W}, b AS (SELECT src AS node, dst AS other, etype FROM ed UNION ALL SELECT dst, src, etype FROM ed), u AS (SELECT node, other, string_agg(DISTINCT etype, ',' ORDER BY etype) AS etypes FROM b WHERE node LIKE 'src_%' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS place FROM u) SELECT * FROM r WHERE place <= 21")
def q16_raw_neighbourhood(spark, d):
    return GS.raw_neighbourhood(EG.edges(spark, d), "src_%", 21)


@query(f"{W} SELECT episode_id, etype, count(*) AS n FROM ed WHERE episode_id <> '' GROUP BY ALL")
def q17_episode_raw_graph(spark, d):
    return EG.edges(spark, d).where("episode_id <> ''").groupBy("episode_id", "etype").agg(F.count("*").alias("n"))


@query(f"{W} SELECT ntype AS kind, count(*) AS n FROM nd GROUP BY ntype UNION ALL SELECT etype, count(*) FROM ed GROUP BY etype UNION ALL SELECT 'facts_open', count(*) FROM fx WHERE belief = 'asserted' AND invalid_at = '' UNION ALL SELECT 'facts_closed', count(*) FROM fx WHERE belief = 'asserted' AND invalid_at <> '' UNION ALL SELECT 'facts_retracted', count(*) FROM fx WHERE belief = 'retracted' HAVING count(*) > 0")
def q19_stats(spark, d):
    return GS.store_stats(EG.nodes(spark, d), EG.edges(spark, d), EG.facts(spark, d))


@query(f"{W} SELECT id, day || ' ' || source AS ref, CASE WHEN length(text) > 0 THEN length(text) ELSE 0 END AS n_chars, 'src_' || source AS source_id FROM ep")
def q31_episode_reference(spark, d):
    ep = EG.episodes(spark, d)
    parent = GS.source_of(EG.edges(spark, d))
    return ep.join(parent, ep["id"] == parent["episode_id"], "left").select("id", F.concat_ws(" ", "day", "source").alias("ref"), F.length("text").alias("n_chars"), "source_id")


@query(f"{W} SELECT src AS episode_id, min(dst) AS source_id FROM ed WHERE etype = 'PART_OF' GROUP BY src")
def q32_source_of(spark, d):
    return GS.source_of(EG.edges(spark, d))


@query(f"{W} SELECT seq, src, rel, dst, valid_at, nullif(invalid_at, '') AS invalid_at, belief, episode_id, confidence, CASE WHEN belief = 'retracted' THEN 'retracted' WHEN invalid_at = '' THEN 'active' ELSE 'closed' END AS status, valid_at AS created_at, confidence AS weight, left(valid_at, 4) AS year FROM fx")
def q33_fact_row(spark, d):
    return GS.fact_rows(EG.facts(spark, d))


@query(f"{W} SELECT 'ep_' || doc_id AS episode_id, string_agg(DISTINCT 'entity_' || name, ',' ORDER BY 'entity_' || name) AS ids FROM en GROUP BY doc_id")
def q35_episode_entity_ids(spark, d):
    star = GS.mention_star(EG.edges(spark, d))
    return star.groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids"))


@query(f"{W}, k AS (SELECT name FROM en WHERE pos = 1 AND doc_id % 5 = 0) SELECT src, dst, string_agg(DISTINCT rel, '/' ORDER BY rel) AS label FROM fx WHERE belief = 'asserted' AND src IN (SELECT 'entity_' || name FROM k) AND dst IN (SELECT 'entity_' || name FROM k) GROUP BY src, dst")
def q37_focused_subgraph(spark, d):
    keep = EG.entities(spark, d).where("pos = 1 and doc_id % 5 = 0").select(F.concat(F.lit("entity_"), "name").alias("id"))
    return GS.focused_subgraph(EG.facts(spark, d), keep)


@query(f"{W} SELECT src, rel, dst FROM fx WHERE belief = 'asserted' AND invalid_at = '' AND (src = 'entity_die' OR dst = 'entity_die') GROUP BY src, rel, dst")
def u07_self_facts(spark, d):
    return GS.facts_for(EG.facts(spark, d), None, 1 << 30).where("entity = 'entity_die'").select("src", "rel", "dst").distinct()


@query(f"{W}, b AS (SELECT src AS node, dst AS other, etype, rel FROM ed UNION ALL SELECT dst, src, etype, rel FROM ed), r AS (SELECT DISTINCT node, other, etype, rel, dense_rank() OVER (PARTITION BY node ORDER BY other, etype, rel) AS place FROM b WHERE node LIKE 'tag_%') SELECT node, other, etype, rel, place FROM r WHERE place <= 25")
def u06_inspect(spark, d):
    return GS.inspect(EG.edges(spark, d), "tag_%", 25)


# ---- erasing


@query(f"{W}, c AS (SELECT id, source FROM ep) SELECT id FROM c WHERE id = 'ep_3' OR source = 'src1' UNION SELECT id FROM ep WHERE contains(lower(text), 'wasser')")
def f02_targets(spark, d):
    ep = EG.episodes(spark, d)
    return GS.erase_targets(ep.select("id", F.col("source").alias("base"), "text"), ["ep_3", "src1"], "Wasser")


@query(f"{W} SELECT src, dst, etype, rel, episode_id NOT IN (SELECT id FROM ep WHERE doc_id % 9 = 2) AS valid, CASE WHEN etype <> 'RELATED_TO' THEN NULL WHEN episode_id IN (SELECT id FROM ep WHERE doc_id % 9 = 2) THEN 'retracted' ELSE 'asserted' END AS belief, count(*) AS n FROM ed GROUP BY ALL")
def f03_retract_edges(spark, d):
    gone = EG.episodes(spark, d).where("doc_id % 9 = 2").select(F.col("id").alias("episode_id"))
    return GS.retract_edges(EG.edges(spark, d), gone).groupBy("src", "dst", "etype", "rel", "valid", "belief").agg(F.count("*").alias("n"))


@query(f"{W} SELECT episode_id, 'fact' AS kind, src || '|' || rel || '|' || dst AS surface FROM fx UNION ALL SELECT 'ep_' || doc_id, 'mention', name FROM en UNION ALL SELECT 'ep_' || doc_id, 'tag', tag FROM tg")
def f07_artifacts(spark, d):
    return GS.artifacts(EG.nodes(spark, d), EG.edges(spark, d))


@query(f"{W}, t AS (SELECT id FROM ep WHERE doc_id % 9 = 2), l AS (SELECT * FROM ed WHERE NOT (src IN (SELECT id FROM t) OR dst IN (SELECT id FROM t) OR episode_id IN (SELECT id FROM t))) SELECT id, ntype FROM nd WHERE ntype IN ('tag', 'source') AND id NOT IN (SELECT src FROM l UNION SELECT dst FROM l) UNION ALL SELECT id, 'episode' FROM t")
def q24_delete_episode(spark, d):
    gone = EG.episodes(spark, d).where("doc_id % 9 = 2").select("id")
    return GS.delete_episodes(EG.nodes(spark, d), EG.edges(spark, d), gone)


# ---- projections


@query(f"{W} SELECT id, name FROM ty WHERE id = 'entity_die' OR name IN ('me', 'die')")
def p03_self_like(spark, d):
    return GS.self_like(EG.entity_types(spark, d), "entity_die", ["me", "die"])


@query(f"{W}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, etype, max(greatest(1e-4, confidence * weight)) AS w FROM ed WHERE src <> dst AND etype <> 'IN_COMMUNITY' AND episode_id NOT IN (SELECT id FROM ep WHERE NOT valid) AND src NOT IN (SELECT id FROM ep WHERE NOT valid) AND dst NOT IN (SELECT id FROM ep WHERE NOT valid) GROUP BY ALL) SELECT a AS src, b AS dst, round(sum(w), 6) AS w FROM p GROUP BY a, b")
def p01_temporal_projection(spark, d):
    valid = EG.nodes(spark, d).where("valid").select("id")
    live = GS.live_edges(EG.edges(spark, d), valid)
    return G.projection(live.where("etype <> 'IN_COMMUNITY'")).select("src", "dst", F.round("w", 6).alias("w"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.projection(EG.edges(spark, d).where("etype in ('TAGGED_AS', 'NEXT')"))


_PAIRS = f"{W}, pw AS (SELECT a, b, sum(w) AS w FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, etype, max(greatest(1e-4, confidence * weight)) AS w FROM ed WHERE etype IN ('TAGGED_AS', 'NEXT') GROUP BY ALL) GROUP BY a, b), bw AS (SELECT a AS src, b AS dst, w FROM pw UNION ALL SELECT b, a, w FROM pw)"


@query(f"{_PAIRS} SELECT src, string_agg(dst || ':' || round(w, 4), ',' ORDER BY dst) AS row FROM bw GROUP BY src")
def p04_adjacency_rows(spark, d):
    return GS.adjacency_rows(_pairs(spark, d))


@query(f"{_PAIRS} SELECT dst, round(w, 6) AS w FROM bw WHERE src = 'ep_1'")
def p18_neighbour_rows(spark, d):
    return G.both_ways(_pairs(spark, d)).where("src = 'ep_1'").select("dst", F.round("w", 6).alias("w"))


_HOPS = f"{_PAIRS}, h0 AS (SELECT 'ep_1' AS id), h1 AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM h0)), h2 AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM h1)), h3 AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM h2)), h4 AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM h3)), hop AS (SELECT id, min(h) AS hop FROM (SELECT id, 0 AS h FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3 UNION ALL SELECT id, 4 FROM h4) GROUP BY id)"


@query(f"{_HOPS} SELECT hop, count(*) AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids FROM hop GROUP BY hop")
def p12_hop_layers(spark, d):
    starts = spark.createDataFrame([("ep_1",)], "id string")
    layers = G.hops(_pairs(spark, d), starts, 4)
    return layers.groupBy("hop").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("id")), ",")).alias("ids"))


@query(f"{_HOPS} SELECT 'ep_1' AS seed, id AS episode_id, round(1.0 / (1 + hop), 6) AS score FROM hop WHERE hop <= 2 AND id LIKE 'ep_%'")
def p11_bfs_scores(spark, d):
    seeds = spark.createDataFrame([("ep_1", 1.0)], "id string, mass double")
    found = GS.bfs_scores(_pairs(spark, d), seeds, 2).where("id like 'ep_%'")
    return found.select(F.lit("ep_1").alias("seed"), F.col("id").alias("episode_id"), F.round("score", 6).alias("score"))


@query(f"{_HOPS}, g AS (SELECT id, 'q' || (doc_id % 4) AS q FROM ep) SELECT q AS query_id, min(hop) AS dist FROM g LEFT JOIN hop USING (id) GROUP BY q")
def p19_seed_gold_distance(spark, d):
    gold = EG.episodes(spark, d).select(F.concat(F.lit("q"), F.col("doc_id") % 4).alias("query_id"), "id")
    starts = spark.createDataFrame([("ep_1",)], "id string")
    return gold.join(G.hops(_pairs(spark, d), starts, 4), "id", "left").groupBy("query_id").agg(F.min("hop").alias("dist"))


@query(f"{W}, c AS (SELECT 'comm_' || source AS comm, doc_id FROM ep), t AS (SELECT comm, tag, count(*) AS n FROM c JOIN tg USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY comm ORDER BY n DESC, tag) AS place FROM t) SELECT comm, string_agg(tag, ', ' ORDER BY place) AS summary FROM r WHERE place <= 8 GROUP BY comm")
def p14_community_summary(spark, d):
    members = EG.episodes(spark, d).select(F.concat(F.lit("comm_"), "source").alias("comm"), "doc_id")
    return GS.community_summaries(members.join(EG.tags(spark, d), "doc_id").select("comm", "tag"), 8)


@query(f"{W}, g AS (SELECT src AS id FROM fx UNION ALL SELECT dst FROM fx), s AS (SELECT id, count(*) AS degree FROM g GROUP BY id) SELECT id, degree, round(degree / (SELECT sum(degree) FROM s), 6) AS share, rank() OVER (ORDER BY degree DESC) AS place FROM s QUALIFY place <= 10")
def p17_hub_stats(spark, d):
    return GS.hub_stats(EG.facts(spark, d), 10)
