"""Queries on extraction and entity resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import extraction as X
from chronoloom.functions import keys as K
from chronoloom.functions import text as T
from chronoloom.operators import extractors as E
from chronoloom.operators import resolution as RS
from chronoloom.plans.registry import query
from chronoloom.sources import episode_graph as EG
from chronoloom.sources.episode_graph import GRAPH_SQL
from chronoloom.sources.tables import table, vectors

PHRASES = ["former economy", "No longer Standard", "past promo", "past tense", "once economy", "used to know", "works with", "ex_partner", "economy"]
VALUES = ["monday and tuesday", "3, 4", "red and blue", "friday", "3 and 3", "5 km, 7 km", "one, two", "sunday, monday and friday"]
CHATS = ["I quit the job yesterday", "my name is Ana", "it took 3 hours", "nothing to see", "we used to go there 2 weeks ago", "costs $20 or 30 euros"]


def _pick(spark: SparkSession, d: str, choices: list[str], name: str) -> DataFrame:
    """A row for each part, with one of the choices in turn."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*[F.lit(c) for c in choices]), (F.col("p_partkey") % len(choices)).cast("int")).alias(name))


def _picked(choices: list[str], name: str) -> str:
    return f"(SELECT p_partkey AS id, ({choices!r})[p_partkey % {len(choices)} + 1] AS {name} FROM part)"


_FLAT = "trim(regexp_replace(lower(label), '[ _-]+', ' ', 'g'))"
_ONCE = ", ".join(f"'{w}'" for w in X.ONCE_RELATIONS)
_BARE = f"regexp_replace({_FLAT}, '^({X.ENDED_PREFIX}) ', '')"
_REST = f"regexp_replace({_FLAT}, '^(past|once) ', '')"
_BASE = f"CASE WHEN {_BARE} <> {_FLAT} THEN {_BARE} WHEN {_REST} <> {_FLAT} AND {_REST} IN ({_ONCE}) THEN {_REST} ELSE {_FLAT} END"


@query("SELECT conv_id, turn, array_to_string(CASE WHEN turn % 2 = 0 THEN [x FOR x, i IN w IF list_position(w, x) = i] ELSE [role] END, ',') AS labels FROM (SELECT conv_id, turn, role, ([x FOR x IN string_split(lower(text), ' ') IF trim(x) <> ''])[1:6] AS w FROM conversations)")
def x02_labels(spark, d):
    w = F.slice(F.filter(F.split(F.lower("text"), " "), lambda x: F.trim(x) != ""), 1, 6)
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(X.coerced_labels(F.when(F.col("turn") % 2 == 0, w), F.col("role")), ",").alias("labels"))


@query(f"SELECT id, {_BASE} AS base, {_BASE} <> {_FLAT} AS ended FROM {_picked(PHRASES, 'label')}")
def x03_termination_prefix(spark, d):
    return _pick(spark, d, PHRASES, "label").select("id", X.base_relation(F.col("label")).alias("base"), X.is_ended(F.col("label")).alias("ended"))


@query(f"SELECT id // 3 AS relation, bool_or({_BASE} <> {_FLAT}) AS ended, string_agg(DISTINCT {_BASE}, ',' ORDER BY {_BASE}) AS labels FROM {_picked(PHRASES, 'label')} GROUP BY id // 3")
def x04_termination_of_relation(spark, d):
    p = _pick(spark, d, PHRASES, "label").withColumn("relation", F.floor(F.col("id") / 3))
    return p.groupBy("relation").agg(F.bool_or(X.is_ended(F.col("label"))).alias("ended"), F.array_join(F.array_sort(F.collect_set(X.base_relation(F.col("label")))), ",").alias("labels"))


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN 'retracted' WHEN id % 5 = 1 OR {_BASE} <> {_FLAT} THEN 'ended' ELSE 'asserted' END AS status FROM {_picked(PHRASES, 'label')}")
def x05_status(spark, d):
    given = F.when(F.col("id") % 5 == 0, "Retracted").when(F.col("id") % 5 == 1, "ended").otherwise("asserted")
    return _pick(spark, d, PHRASES, "label").select("id", X.status_of(given, X.is_ended(F.col("label"))).alias("status"))


_PARTS = "string_split_regex(trim(value), '\\s*,\\s*|\\s+and\\s+')"
_DAYS = "|".join(X.WEEKDAYS)


@query(f"SELECT id, array_to_string(CASE WHEN len({_PARTS}) > 1 AND len([x FOR x IN {_PARTS} IF NOT regexp_full_match(x, '({_DAYS})|[0-9]+( [a-z]+)?')]) = 0 AND len(list_distinct({_PARTS})) = len({_PARTS}) THEN {_PARTS} ELSE [trim(value)] END, '|') AS parts FROM {_picked(VALUES, 'value')}")
def x06_compound(spark, d):
    return _pick(spark, d, VALUES, "value").select("id", F.array_join(X.compound_parts(F.col("value")), "|").alias("parts"))


@query(f"WITH {GRAPH_SQL}, s AS (SELECT *, CASE WHEN belief = 'retracted' THEN 2 WHEN invalid_at <> '' THEN 1 ELSE 0 END AS rk FROM fx) SELECT src, dst, valid_at AS valid_from, string_agg(DISTINCT rel, ',' ORDER BY rel) AS labels, CASE max(rk) WHEN 2 THEN 'retracted' WHEN 1 THEN 'ended' ELSE 'asserted' END AS status, max(nullif(invalid_at, '')) AS valid_to FROM s GROUP BY src, dst, valid_at")
def x07_merge(spark, d):
    status = F.when(F.col("belief") == "retracted", "retracted").when(F.col("invalid_at") != "", "ended").otherwise("asserted")
    rows = EG.facts(spark, d).select(F.upper("src").alias("src"), "dst", F.col("valid_at").alias("valid_from"), F.col("rel").alias("label"), status.alias("status"), F.col("invalid_at").alias("valid_to"))
    return E.merge_extractions(rows)


@query("WITH k AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k, min(item_id) AS item_id FROM benchmark GROUP BY 1) SELECT d.doc_id AS id, coalesce(k.item_id::VARCHAR, '') AS entities FROM documents d LEFT JOIN k ON k.k = trim(regexp_replace(lower(left(d.text, 200)), '\\s+', ' ', 'g'))")
def x11_scripted(spark, d):
    known = table(spark, d, "benchmark").groupBy("text").agg(F.array(F.min("item_id").cast("string")).alias("entities"))
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("text"))
    return E.scripted(items, known).select("id", F.array_join("entities", ",").alias("entities"))


_KINDS = "[k FOR k IN [" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{X.CUES[k]}') THEN '{k}' END" for k in sorted(X.CUES)) + "] IF k IS NOT NULL]"


@query(f"SELECT id, array_to_string({_KINDS}, ',') AS kinds FROM {_picked(CHATS, 'text')}")
def x15_cue_kinds(spark, d):
    return _pick(spark, d, CHATS, "text").select("id", F.array_join(X.cue_kinds(F.col("text")), ",").alias("kinds"))


@query(f"SELECT id, len({_KINDS}) > 0 AS cue FROM {_picked(CHATS, 'text')}")
def x16_has_cue(spark, d):
    return _pick(spark, d, CHATS, "text").select("id", X.has_cue(F.col("text")).alias("cue"))


@query(f"WITH k AS (SELECT {_KINDS} AS k FROM {_picked(CHATS, 'text')}) SELECT count(*) AS seen, count(*) FILTER (len(k) > 0) AS escalated, round(count(*) FILTER (len(k) > 0) / count(*), 3) AS rate, " + ", ".join(f"count(*) FILTER (list_contains(k, '{k}')) AS {k}" for k in sorted(X.CUES)) + " FROM k")
def x13_escalation(spark, d):
    return E.escalation_summary(_pick(spark, d, CHATS, "text"))


@query("WITH t AS (SELECT conv_id, turn, '[chat session — 2024/01/01]' || chr(10) || 'User: ' || coalesce(text, '') || chr(10) || 'Assistant: so User: no' AS t FROM conversations) SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(t, '^\\[chat session[^\\]]*\\]\\n?', ''), '(?m)^(User|Assistant|System): ', '', 'g'))) AS plain FROM t")
def x17_denoise(spark, d):
    chat = F.concat(F.lit("[chat session — 2024/01/01]\nUser: "), F.coalesce("text", F.lit("")), F.lit("\nAssistant: so User: no"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.denoised(chat)).alias("plain"))


@query(f"WITH {GRAPH_SQL}, r AS (SELECT doc_id AS id, name, 1.0 / pos AS score FROM en UNION ALL SELECT doc_id, upper(tag), 0.3 FROM tg UNION ALL SELECT doc_id, 'She', 0.9 FROM en) SELECT id, lower(name) AS name, round(max(score), 6) AS score FROM r WHERE lower(name) NOT IN ({', '.join(repr(p) for p in X.PRONOUNS)}) GROUP BY id, lower(name)")
def x20_entity_dedup(spark, d):
    en = EG.entities(spark, d).select(F.col("doc_id").alias("id"), "name", (1.0 / F.col("pos")).alias("score"))
    more = EG.tags(spark, d).select(F.col("doc_id").alias("id"), F.upper("tag").alias("name"), F.lit(0.3).alias("score"))
    said = en.select("id", F.lit("She").alias("name"), F.lit(0.9).alias("score"))
    return E.dedup_entities(en.unionByName(more).unionByName(said)).withColumn("score", F.round("score", 6))


_SENT = "[trim(x) FOR x IN string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)) IF trim(x) <> '']"


@query(f"WITH {GRAPH_SQL}, s AS (SELECT doc_id AS id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS line FROM documents), a AS (SELECT id, line, name, instr(lower(s), name) AS p, regexp_matches(lower(s), '{X.CUES['termination']}') AS ended FROM s JOIN en ON en.doc_id = id WHERE instr(lower(s), name) > 0), n AS (SELECT *, lead(name) OVER (PARTITION BY id, line ORDER BY p, name) AS other FROM a), o AS (SELECT id, name AS src, other AS dst, min({{'line': line, 'p': p, 'ended': ended}}) AS m FROM n WHERE other IS NOT NULL AND other <> name GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, dst) AS k FROM o) SELECT id, src, dst, CASE WHEN m.ended THEN 'ended' ELSE 'asserted' END AS status, 0.6::DOUBLE AS confidence FROM r WHERE k <= 40")
def x25_cooccurrences(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return E.cooccurrences(items, EG.entities(spark, d).select(F.col("doc_id").alias("id"), "name"))


@query("SELECT event_id, rtrim(regexp_replace(value::VARCHAR, '\\.0$', '') || ' ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'kg' END) AS shown FROM events")
def x35_quantity(spark, d):
    return table(spark, d, "events").select("event_id", X.quantity_text(F.col("value"), F.when(F.col("event_id") % 3 != 0, "kg")).alias("shown"))


@query(f"WITH {GRAPH_SQL} SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (SELECT count(*) FROM en WHERE en.doc_id = ep.doc_id) END AS n_entities, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE (SELECT count(*) FROM tg WHERE tg.doc_id = ep.doc_id) END AS n_tags FROM ep")
def x42_fan_out(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "file").otherwise("text").alias("kind"), F.lit("").alias("title"), "text")
    return E.extract(items, E.extractor("surface")).select("id", F.size("entities").cast("long").alias("n_entities"), F.size("tags").cast("long").alias("n_tags"))


@query("SELECT doc_id, 0 AS n FROM documents")
def x32_structure_only(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.lit("").alias("title"), "text")
    return E.extract(items, E.extractor("structure")).select(F.col("id").alias("doc_id"), (F.size("entities") + F.size("tags")).alias("n"))


@query(f"WITH w AS (SELECT doc_id, [lower(x) FOR x IN [x FOR x IN string_split_regex(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}_]+') IF x <> ''] IF length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND lower(x) NOT IN ('the', 'and')] AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS t FROM w) SELECT doc_id, least(14, count(DISTINCT t)) AS n FROM w LEFT JOIN u USING (doc_id) GROUP BY doc_id")
def x33_keywords(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.lit("").alias("title"), "text")
    return E.extract(items, E.extractor("keywords")).select(F.col("id").alias("doc_id"), F.size("tags").cast("long").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Item ' || page_id WHEN t <> '' THEN left(t, 200) ELSE url END AS title FROM (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages)")
def x39_title(spark, d):
    t = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    given = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("Item "), "page_id"))
    return table(spark, d, "pages").select("page_id", F.coalesce(given, F.when(t != "", F.substring(t, 1, 200)), F.col("url")).alias("title"))


@query("SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN source || chr(10) || lang WHEN 1 THEN lang WHEN 2 THEN text || chr(10) || lang ELSE CASE WHEN length(text) > 6000 THEN left(text, 2000) ELSE text END END) AS surface FROM documents")
def x41_embed_surface(spark, d):
    kind = F.when(F.col("doc_id") % 4 == 0, "link").when(F.col("doc_id") % 4 == 1, "media").when(F.col("doc_id") % 4 == 2, "captioned").otherwise("text")
    return table(spark, d, "documents").select("doc_id", F.md5(X.embed_surface(kind, F.col("source"), F.col("text"), F.col("lang"))).alias("surface"))


@query("SELECT doc_id, coalesce([x FOR x IN [trim(regexp_replace(y, '^[# ]+', '')) FOR y IN string_split(CASE WHEN doc_id % 3 = 0 THEN '' ELSE '## ' || text END, chr(10))] IF x <> ''][1], 'A code project named ' || source || '.') AS description FROM documents")
def x44_repo_description(spark, d):
    readme = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("## "), "text"))
    return table(spark, d, "documents").select("doc_id", X.repo_description(readme, F.col("source")).alias("description"))


@query("SELECT page_id, length('URL: ' || url || chr(10) || 'TITLE: ' || trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) || chr(10) || 'BODY: ' || left(html, 500)) AS n FROM pages")
def x45_prompt_block(spark, d):
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    block = F.concat_ws("\n", F.concat(F.lit("URL: "), "url"), F.concat(F.lit("TITLE: "), title), F.concat(F.lit("BODY: "), F.substring("html", 1, 500)))
    return table(spark, d, "pages").select("page_id", F.length(block).cast("long").alias("n"))


@query(f"WITH {GRAPH_SQL} SELECT lang, count(DISTINCT doc_id) AS n_items, count(*) AS n_entities, count(DISTINCT name) AS n_distinct FROM en JOIN ep USING (doc_id) GROUP BY lang")
def x36_extraction_dump(spark, d):
    en = EG.entities(spark, d).join(EG.episodes(spark, d).select("doc_id", "lang"), "doc_id")
    return en.groupBy("lang").agg(F.countDistinct("doc_id").alias("n_items"), F.count("*").alias("n_entities"), F.countDistinct("name").alias("n_distinct"))


@query("SELECT doc_id AS id, 'Ana' AS entity, 'concept' AS type, CASE WHEN doc_id % 2 = 0 THEN 'sport' END AS tag, CASE WHEN doc_id % 3 = 0 THEN 2.5::DOUBLE END AS value FROM documents")
def x01_payload(spark, d):
    body = F.concat(
        F.lit('{"entities": [{"name": " Ana ", "type": "TERM"}, {"name": "", "type": "person"}], "tags": ["note"'), F.when(F.col("doc_id") % 2 == 0, ', "Sport"').otherwise(""),
        F.lit('], "facts": [{"subject": "a", "predicate": "b", "value": '), F.when(F.col("doc_id") % 3 == 0, "2.5").otherwise("null"), F.lit("}]}"),
    )
    p = E.payloads(table(spark, d, "documents").select(F.col("doc_id").alias("id"), body.alias("body")), "body", ["note"])
    return p.select("id", F.col("entities")[0]["name"].alias("entity"), F.col("entities")[0]["type"].alias("type"), F.get("tags", F.lit(0)).alias("tag"), F.get("facts", F.lit(0))["value"].alias("value"))


# ---- resolution

WORDS = ["cities", "boxes", "glasses", "running", "walked", "bus", "class", "prizes", "sees", "studies", "king", "red"]


@query(f"SELECT id, CASE WHEN length(w) <= 4 THEN w WHEN w LIKE '%ies' THEN w[:-4] || 'y' WHEN w LIKE '%es' AND NOT (w LIKE '%ses' OR w LIKE '%zes') THEN w[:-3] WHEN w LIKE '%s' AND NOT w LIKE '%ss' THEN w[:-2] ELSE w END AS s FROM {_picked(WORDS, 'w')}")
def k02_singular(spark, d):
    return _pick(spark, d, WORDS, "w").select("id", K.singular(F.col("w")).alias("s"))


@query(f"WITH p AS (SELECT id, CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-3] ELSE w END AS w FROM {_picked(WORDS, 'w')}) SELECT id, CASE WHEN length(w) <= 4 THEN w WHEN w LIKE '%ies' THEN w[:-4] || 'y' WHEN w LIKE '%es' AND NOT (w LIKE '%ses' OR w LIKE '%zes') THEN w[:-3] WHEN w LIKE '%s' AND NOT w LIKE '%ss' THEN w[:-2] ELSE w END AS s FROM p")
def k04_verb_stem(spark, d):
    return _pick(spark, d, WORDS, "w").select("id", K.verb_stem(F.col("w")).alias("s"))


RELATIONS = ["likes", "liked by", "dislikes", "works for", "works at", "hired", "fires", "hired by", ""]


@query()
def k07_merge_veto(spark, d):
    a, b = _pick(spark, d, RELATIONS, "a"), _pick(spark, d, RELATIONS[::-1], "b")
    return a.join(b, "id").select("id", X.merge_vetoed(F.col("a"), F.col("b")).alias("vetoed"))


@query(f"SELECT id, CASE WHEN w[len(w)] IN ('at', 'for', 'by') THEN w[len(w)] ELSE '' END AS marker FROM (SELECT id, string_split(r, ' ') AS w FROM {_picked(RELATIONS, 'r')})")
def k30_trailing_marker(spark, d):
    return _pick(spark, d, RELATIONS, "r").select("id", X.trailing_marker(F.col("r")).alias("marker"))


_KEYED = f"WITH {GRAPH_SQL}, m AS (SELECT doc_id, pos, name, CASE WHEN length(name) <= 4 THEN name WHEN name LIKE '%ies' THEN name[:-4] || 'y' WHEN name LIKE '%es' AND NOT (name LIKE '%ses' OR name LIKE '%zes') THEN name[:-3] WHEN name LIKE '%s' AND NOT name LIKE '%ss' THEN name[:-2] ELSE name END AS key FROM en)"


@query(f"{_KEYED}, f AS (SELECT key, arg_min(name, (doc_id, pos)) AS first FROM m GROUP BY key) SELECT doc_id, pos, first AS node FROM m JOIN f USING (key)")
def k12_resolve_entity(spark, d):
    m = EG.entities(spark, d).withColumn("key", K.surface_key(F.col("name")))
    return RS.resolve_by_key(m, "key", "name", ["doc_id", "pos"]).select("doc_id", "pos", F.col("first").alias("node"))


@query(f"WITH {GRAPH_SQL}, m AS (SELECT seq, rel FROM fx), f AS (SELECT rel, min(seq) AS first FROM m GROUP BY rel) SELECT seq, printf('rel_%04d', dense_rank() OVER (ORDER BY first)) AS node FROM m JOIN f USING (rel)")
def k13_resolve_relation(spark, d):
    m = EG.facts(spark, d).select("seq", "rel").withColumn("key", K.relation_key(F.col("rel")))
    ids = RS.fresh_ids(m.groupBy("key").agg(F.min("seq").alias("first")), "rel", "first")
    return m.join(F.broadcast(ids.select("key", F.col("id").alias("node"))), "key").select("seq", "node")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.label = b.label),
 r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM s WHERE score >= 0.3) SELECT src, dst, 'SIMILAR_TO' AS etype, score AS confidence, score AS weight FROM r WHERE n <= 3""")
def k14_synonymy(spark, d):
    return RS.synonymy_links(vectors(spark, d), 3, 0.3)


TYPES = ["person", "place", "other", "org"]


@query(f"WITH t AS (SELECT a.id, a.t AS a, CASE WHEN a.id % 5 = 0 THEN NULL ELSE b.t END AS b FROM {_picked(TYPES, 't')} a JOIN {_picked(TYPES[::-1] + ['person'], 't')} b USING (id)) SELECT id, b IS NULL OR a = 'other' OR b = 'other' OR a = b AS compatible FROM t")
def k16_types_compatible(spark, d):
    b = _pick(spark, d, TYPES[::-1] + ["person"], "b").withColumn("b", F.when(F.col("id") % 5 != 0, F.col("b")))
    return _pick(spark, d, TYPES, "a").join(b, "id").select("id", X.types_compatible(F.col("a"), F.col("b")).alias("compatible"))


@query(f"WITH t AS (SELECT id // 3 AS node, id, t FROM {_picked(TYPES, 't')}) SELECT node, coalesce(arg_min(t, id) FILTER (t <> 'other'), 'other') AS entity_type FROM t GROUP BY node")
def k17_type_upgrade(spark, d):
    t = _pick(spark, d, TYPES, "t").withColumn("node", F.floor(F.col("id") / 3))
    return RS.upgraded_types(t, "node", "t", "id").select("node", F.col("t").alias("entity_type"))


@query(f"{_KEYED}, f AS (SELECT key, arg_min(name, (doc_id, pos)) AS first FROM m GROUP BY key), a AS (SELECT DISTINCT key, first, name FROM m JOIN f USING (key) WHERE name <> first) SELECT first AS node, string_agg(name, ',' ORDER BY name) AS aliases FROM a GROUP BY first, key")
def k18_aliases(spark, d):
    m = EG.entities(spark, d).withColumn("key", K.surface_key(F.col("name")))
    return RS.aliases(RS.resolve_by_key(m, "key", "name", ["doc_id", "pos"]), "key", "name").select(F.col("first").alias("node"), F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {GRAPH_SQL}, m AS (SELECT CASE WHEN src LIKE 'entity_d%' THEN 'entity_d' ELSE src END AS s, CASE WHEN dst LIKE 'entity_d%' THEN 'entity_d' ELSE dst END AS t, rel, seq FROM fx) SELECT CASE WHEN rel = 'knows' THEN least(s, t) ELSE s END AS src, CASE WHEN rel = 'knows' THEN greatest(s, t) ELSE t END AS dst, rel, seq FROM m WHERE s <> t")
def k23_reattach(spark, d):
    to = EG.entity_types(spark, d).where("id like 'entity_d%'").select(F.col("id").alias("loser"), F.lit("entity_d").alias("survivor"))
    return RS.reattach(EG.facts(spark, d).select("src", "dst", "rel", "seq"), to, ["knows"])


@query(f"WITH {GRAPH_SQL}, q AS (SELECT DISTINCT doc_id, tag AS s FROM tg UNION SELECT doc_id, name FROM en WHERE pos = 1), g AS (SELECT DISTINCT tag FROM tg) SELECT q.doc_id, q.s AS surface, CASE WHEN e.name IS NOT NULL THEN 'entity_' || q.s WHEN t.tag IS NOT NULL OR g.tag IS NOT NULL THEN 'tag_' || q.s ELSE 'new_' || q.s END AS node FROM q LEFT JOIN en e ON e.doc_id = q.doc_id AND e.name = q.s LEFT JOIN tg t ON t.doc_id = q.doc_id AND t.tag = q.s LEFT JOIN g ON g.tag = q.s")
def k27_endpoints(spark, d):
    en, tg = EG.entities(spark, d), EG.tags(spark, d)
    asked = tg.select("doc_id", F.col("tag").alias("surface")).unionByName(en.where("pos = 1").select("doc_id", F.col("name").alias("surface"))).distinct()
    return RS.endpoints(asked, en.select("doc_id", F.col("name").alias("surface")), tg.select("doc_id", F.col("tag").alias("surface")))


@query(f"WITH {GRAPH_SQL}, c AS (SELECT name, CASE WHEN entity_type IN ('person', 'place') THEN entity_type ELSE 'thing' END AS c FROM ty) SELECT left(name, 1) AS letter, coalesce(min(c) FILTER (c <> 'thing'), 'thing') AS category FROM c GROUP BY 1")
def k28_category(spark, d):
    t = EG.entity_types(spark, d).select(F.substring("name", 1, 1).alias("letter"), RS.category(F.col("entity_type")).alias("c"))
    return t.groupBy("letter").agg(F.coalesce(F.min(F.when(F.col("c") != "thing", F.col("c"))), F.lit("thing")).alias("category"))


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT trim(name) AS surface FROM en UNION SELECT trim(tag) FROM tg")
def k29_surfaces(spark, d):
    return RS.distinct_surfaces(EG.entities(spark, d).select(F.concat(F.lit(" "), "name").alias("surface")), EG.tags(spark, d).select(F.col("tag").alias("surface")))


@query("SELECT doc_id, array_to_string([x FOR x, i IN l IF list_position(l, x) = i], ' ') AS u FROM (SELECT doc_id, list_concat(string_split(lower(text), ' ')[1:5], string_split(lower(text), ' ')[3:8]) AS l FROM documents WHERE text IS NOT NULL)")
def k31_ordered_union(spark, d):
    w = F.split(F.lower("text"), " ")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.ordered_union(F.slice(w, 1, 5), F.slice(w, 3, 6)), " ").alias("u"))


@query("SELECT segment, printf('tag_%04d', 7 + row_number() OVER (ORDER BY first)) AS id FROM (SELECT c_mktsegment AS segment, min(c_custkey) AS first FROM customer GROUP BY 1)")
def k32_fresh_ids(spark, d):
    first = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.min("c_custkey").alias("first"))
    return RS.fresh_ids(first, "tag", "first", 7).select("segment", "id")


@query()
def k26_gate(spark, d):
    return RS.gate(spark)


@query("SELECT lang, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def k33_pair_counts(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return RS.pair_counts(j.select("lang", (F.col("quality") == 0).alias("said"), (F.col("toxic") == 1).alias("gold")), ["lang"])
