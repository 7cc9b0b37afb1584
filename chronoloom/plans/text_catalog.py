"""Queries on chunks, surfaces, saving, evaluation, reading and erasure, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import keys as K
from chronoloom.functions import text as X
from chronoloom.operators import graph as G
from chronoloom.operators import store as S
from chronoloom.plans.registry import query
from chronoloom.sources.tables import FACT_STREAM_SQL, fact_stream, table

# ---- chunks

_SPLIT = "[x FOR x IN string_split_regex(coalesce({0}, ''), '[ \\t\\n\\r\\f]+') IF x <> '']"
_WORDS = "[x FOR x IN string_split_regex(coalesce({0}, ''), '[^\\p{{L}}\\p{{N}}_]+') IF x <> '']"
_SENTENCES = "[trim(x) FOR x IN string_split(regexp_replace(regexp_replace(coalesce({0}, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)) IF trim(x) <> '']"
_CHUNKS = f"w AS (SELECT doc_id, {_SPLIT.format('text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range((len(w) + 109) // 110)) AS pos FROM w)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.word_windows(F.col("text"))).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


@query("WITH p AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) > 6000 THEN (least(length(text), 36000) + 5999) // 6000 ELSE 1 END)) AS pos FROM documents) SELECT doc_id, pos, md5(CASE WHEN length(text) > 6000 THEN text[pos * 6000 + 1:(pos + 1) * 6000] ELSE text END) AS part FROM p")
def c15_char_windows(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(X.char_windows(F.col("text"))).alias("pos", "part"))
    return parts.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("part").alias("part"))


@query(f"WITH {_CHUNKS} SELECT doc_id, pos, md5(array_to_string(w[pos * 110 + 1:(pos + 1) * 110], ' ')) AS part FROM c")
def c16_word_windows(spark, d):
    return _chunks(spark, d).withColumn("part", F.md5("part"))


@query(f"WITH {_CHUNKS} SELECT printf('doc_%d#c%03d', doc_id, pos) AS chunk_id, 'src_doc_' || doc_id AS parent FROM c")
def c13_chunk_ids(spark, d):
    return _chunks(spark, d).select(F.format_string("doc_%d#c%03d", "doc_id", "pos").alias("chunk_id"), F.concat(F.lit("src_doc_"), "doc_id").alias("parent"))


@query(f"WITH {_CHUNKS}, n AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM c) SELECT doc_id, pos, 'PART_OF' AS etype, NULL::BIGINT AS dst, 0.3::DOUBLE AS weight FROM n UNION ALL SELECT doc_id, pos, 'NEXT', nxt, 0.5::DOUBLE FROM n WHERE nxt IS NOT NULL")
def c14_chunk_edges(spark, d):
    c = _chunks(spark, d).drop("part").withColumn("nxt", F.lead("pos").over(Window.partitionBy("doc_id").orderBy("pos")))
    part_of = c.select("doc_id", "pos", F.lit("PART_OF").alias("etype"), F.lit(None).cast("long").alias("dst"), F.lit(0.3).alias("weight"))
    return part_of.unionByName(c.where("nxt is not null").select("doc_id", "pos", F.lit("NEXT").alias("etype"), F.col("nxt").alias("dst"), F.lit(0.5).alias("weight")))


@query(f"SELECT doc_id, len({_SENTENCES.format('text')})::BIGINT AS n, md5(array_to_string({_SENTENCES.format('text')}, '|')) AS digest FROM documents")
def c18_sentences(spark, d):
    s = X.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


# ---- surfaces

_NAMES = f"n AS (SELECT doc_id, [lower(x) FOR x IN {_WORDS.format('text')} IF regexp_full_match(x, '[A-Z][a-z][a-z]+')] AS l FROM documents)"
_TAGS = f"t AS (SELECT doc_id, [x FOR x IN {_WORDS.format('lower(text)')} IF regexp_full_match(x, '[a-z]{{5,}}')] AS l FROM documents)"
_FIRST = "(SELECT coalesce(string_agg(w, ',' ORDER BY i), '') FROM (SELECT w, min(i) AS i FROM (SELECT unnest({0}) AS w, generate_subscripts({0}, 1) AS i) GROUP BY w ORDER BY 2 LIMIT {1}))"


@query(f"WITH {_NAMES}, {_TAGS} SELECT n.doc_id, {_FIRST.format('n.l', 8)} AS entities, {_FIRST.format('t.l', 3)} AS tags FROM n JOIN t USING (doc_id)")
def x31_mock_extraction(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(X.capitalised(text), ",").alias("entities"), F.array_join(X.plain_tags(text), ",").alias("tags"))


@query(f"WITH w AS (SELECT doc_id, [lower(x) FOR x IN {_WORDS.format('text')} IF length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND lower(x) NOT IN ('the', 'and')] AS l FROM documents) SELECT doc_id, {_FIRST.format('l', 12)} AS tags FROM w")
def x24_clean_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.clean_tags(X.words(F.col("text")), ["the", "and"], 12), ",").alias("tags"))


@query(f"WITH {_TAGS}, f AS (SELECT doc_id, unnest(string_split({_FIRST.format('l', 3)}, ',')) AS tag FROM t) SELECT tag, count(*) AS n FROM f WHERE tag <> '' GROUP BY tag ORDER BY n DESC, tag LIMIT 25")
def x37_top_tags(spark, d):
    tags = table(spark, d, "documents").select(F.explode(X.plain_tags(F.col("text"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(25)


@query("SELECT doc_id, nullif(instr(lower(text), 'the'), 0) - 1 AS start, nullif(instr(lower(text), 'the'), 0) + 2 AS stop FROM documents")
def x38_char_span(spark, d):
    span = X.char_span(F.col("text"), F.lit("The"))
    return table(spark, d, "documents").select("doc_id", span["start"].cast("long").alias("start"), span["end"].cast("long").alias("stop"))


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS f FROM documents) SELECT doc_id, nullif(rtrim(string_split(regexp_replace(f, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))[1][1:80]), '') AS title FROM f")
def x40_title(spark, d):
    return table(spark, d, "documents").select("doc_id", X.title(F.col("text")).alias("title"))


# ---- keys and nodes


@query("WITH k AS (SELECT p_partkey AS id, CASE WHEN length(p_name) <= 4 THEN p_name WHEN p_name LIKE '%ies' THEN p_name[:-4] || 'y' WHEN p_name LIKE '%es' AND NOT (p_name LIKE '%ses' OR p_name LIKE '%zes') THEN p_name[:-3] WHEN p_name LIKE '%s' AND NOT p_name LIKE '%ss' THEN p_name[:-2] ELSE p_name END AS key FROM part), c AS (SELECT id, unnest(string_split(key, '')) AS c FROM k), n AS (SELECT id, c, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM n), e AS (SELECT id, round(-sum(p * log2(p)), 9) AS bits FROM s GROUP BY id) SELECT id, bits >= 2.0 AND length(key) >= 4 AS mergeable FROM e JOIN k USING (id)")
def k10_entropy_guard(spark, d):
    key = K.surface_key(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.round(K.char_entropy(key), 9) >= 2.0) & (F.length(key) >= 4)).alias("mergeable"))


@query(f"WITH w AS (SELECT conv_id, turn, lower(({_WORDS.format('text')})[1]) AS w FROM conversations) SELECT conv_id, turn, CASE WHEN w IN ('i', 'me', 'my', 'mine', 'myself') THEN 'entity_self' ELSE w END AS node_id FROM w")
def k19_self_anchor(spark, d):
    first = F.lower(F.get(X.words(F.col("text")), 0))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(first.isin(K.FIRST_PERSON), "entity_self").otherwise(first).alias("node_id"))


@query("WITH k AS (SELECT lower(c_name) AS key, 0 AS prio, c_custkey AS id FROM customer UNION ALL SELECT lower(c_mktsegment), 1, c_custkey FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, id) AS n FROM k) SELECT key, id FROM r WHERE n = 1")
def k20_key_map(spark, d):
    c = table(spark, d, "customer")
    named = c.select(F.lower("c_name").alias("key"), F.struct(F.lit(0), "c_custkey").alias("at"))
    every = named.unionByName(c.select(F.lower("c_mktsegment").alias("key"), F.struct(F.lit(1), "c_custkey").alias("at")))
    return every.groupBy("key").agg(F.min("at").alias("at")).select("key", F.col("at.c_custkey").alias("id"))


_LOSERS = "l AS (SELECT DISTINCT src AS loser, 'user_' || (substr(src, 6)::INT - 1) AS survivor FROM facts WHERE substr(src, 6)::INT % 5 = 4)"


@query(f"WITH {FACT_STREAM_SQL}, {_LOSERS}, m AS (SELECT coalesce(survivor, src) AS src, dst, rel AS etype, confidence, seq FROM facts LEFT JOIN l ON src = loser), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, etype ORDER BY confidence DESC, seq DESC) AS n FROM m) SELECT src, dst, etype, seq FROM r WHERE n = 1")
def k21_merge_nodes(spark, d):
    f = fact_stream(spark, d)
    number = F.substring("src", 6, 20).cast("int")
    losers = f.where(number % 5 == 4).select(F.col("src").alias("loser"), F.concat(F.lit("user_"), number - 1).alias("survivor")).distinct()
    edges = f.select("src", "dst", F.col("rel").alias("etype"), "confidence", F.lit(1.0).alias("weight"), "seq")
    return S.merge_nodes(edges, losers).select("src", "dst", "etype", "seq")


@query(f"WITH {FACT_STREAM_SQL} SELECT src, rel, dst, max(confidence) AS confidence, string_agg(DISTINCT episode_id, ',' ORDER BY episode_id) AS confirmed_by FROM facts GROUP BY ALL")
def k22_collapse_facts(spark, d):
    return fact_stream(spark, d).groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"), F.array_join(F.sort_array(F.collect_set("episode_id")), ",").alias("confirmed_by"))


@query(f"WITH {FACT_STREAM_SQL}, n AS (SELECT src AS node, episode_id FROM facts UNION SELECT dst, episode_id FROM facts) SELECT node, count(*) AS df FROM n GROUP BY node")
def k24_document_frequency(spark, d):
    return fact_stream(spark, d).select(F.explode(F.array("src", "dst")).alias("node"), "episode_id").groupBy("node").agg(F.countDistinct("episode_id").alias("df"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'CHANGED' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 14 <> 0")
def w01_upsert(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    delta = base.where("id % 7 = 0").select("id", F.lit("CHANGED").alias("segment"), (F.col("id") % 14 == 0).alias("removed"))
    return S.upsert(base, delta, ["id"])


@query("SELECT conv_id, sha256('v1' || chr(10) || string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS cache_key FROM conversations GROUP BY conv_id")
def w11_cache_key(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), X.filled(F.col("text"))).alias("line"))))
    body = F.array_join(F.transform(turns, lambda t: t["line"]), "\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.concat(F.lit("v1\n"), body), 256).alias("cache_key"))


# ---- evaluation


@query(f"WITH {FACT_STREAM_SQL} SELECT dst AS entity, count(DISTINCT src) AS n FROM facts GROUP BY dst HAVING count(DISTINCT src) >= 2")
def e05_shared_entities(spark, d):
    return fact_stream(spark, d).groupBy(F.col("dst").alias("entity")).agg(F.countDistinct("src").alias("n")).where("n >= 2")


@query(f"WITH {FACT_STREAM_SQL} SELECT seq, dst AS tag, row_number() OVER (PARTITION BY dst ORDER BY at, seq) AS df FROM facts")
def e15_frequency_series(spark, d):
    return fact_stream(spark, d).select("seq", F.col("dst").alias("tag"), F.row_number().over(Window.partitionBy("dst").orderBy("at", "seq")).cast("long").alias("df"))


@query(f"WITH {FACT_STREAM_SQL}, p AS (SELECT src, dst, count(DISTINCT rel) AS n FROM facts GROUP BY ALL) SELECT count(*) AS pairs, max(n) AS most, round(avg(n), 3) AS mean FROM p")
def e16_pair_relations(spark, d):
    p = fact_stream(spark, d).groupBy("src", "dst").agg(F.countDistinct("rel").alias("n"))
    return p.agg(F.count("*").alias("pairs"), F.max("n").alias("most"), F.round(F.avg("n"), 3).alias("mean"))


@query()
def e23_amount(spark, d):
    return table(spark, d, "events").select("event_id", X.amount(F.concat(F.lit("$"), F.col("value").cast("string"))).alias("amount"))


@query("WITH r(event_type, rate) AS (VALUES ('click', 0.15), ('view', 0.6)) SELECT event_type, round(sum(coalesce(value, 0) * coalesce(rate, 1.0)) / 1000, 4) AS usd, count(*) AS calls FROM events LEFT JOIN r USING (event_type) GROUP BY event_type")
def e32_usage_price(spark, d):
    rates = spark.createDataFrame([("click", 0.15), ("view", 0.6)], "event_type string, rate double")
    priced = table(spark, d, "events").join(rates, "event_type", "left").withColumn("usd", F.coalesce("value", F.lit(0.0)) * F.coalesce("rate", F.lit(1.0)))
    return priced.groupBy("event_type").agg(F.round(F.sum("usd") / 1000, 4).alias("usd"), F.count("*").alias("calls"))


_OUTCOME = "CASE WHEN toxic IS NULL THEN 'missing' WHEN quality = toxic THEN 'same' WHEN quality > toxic THEN 'gain' ELSE 'loss' END"


@query(f"SELECT lang, {_OUTCOME} AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def e37_run_comparison(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    outcome = F.when(t.isNull(), "missing").when(q == t, "same").when(q > t, "gain").otherwise("loss")
    return both.groupBy("lang", outcome.alias("outcome")).agg(F.count("*").alias("n"))


_LONG = "list_distinct([x FOR x IN regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+') IF length(x) > 1])"


@query(f"WITH p AS (SELECT a.conv_id, a.turn, {_LONG.format('a.text')} AS want, {_LONG.format('b.text')} AS have FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, CASE WHEN len(want) > 0 THEN round(len(list_intersect(want, have)) / len(want), 6) END AS share FROM p")
def e41_evidence_share(spark, d):
    c = table(spark, d, "conversations")
    long = lambda s: F.array_distinct(F.filter(K.tokens(X.filled(s)), lambda t: F.length(t) > 1))
    reply = c.select("conv_id", (F.col("turn") - 1).alias("turn"), long(F.col("text")).alias("have"))
    both = c.select("conv_id", "turn", long(F.col("text")).alias("want")).join(reply, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.when(F.size("want") > 0, F.round(F.size(F.array_intersect("want", "have")) / F.size("want"), 6)).alias("share"))


@query(f"WITH {FACT_STREAM_SQL}, s AS (SELECT rel, at[1:10] AS day, count(*) AS n FROM facts GROUP BY ALL) SELECT rel, day, n - coalesce(lag(n) OVER (PARTITION BY rel ORDER BY day), 0) AS delta FROM s")
def e42_step_deltas(spark, d):
    s = fact_stream(spark, d).groupBy("rel", F.substring("at", 1, 10).alias("day")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.lag("n").over(Window.partitionBy("rel").orderBy("day")), F.lit(0))
    return s.select("rel", "day", (F.col("n") - before).alias("delta"))


# ---- reading


@query(f"WITH {FACT_STREAM_SQL}, b AS (SELECT DISTINCT src, dst FROM facts UNION SELECT dst, src FROM facts) SELECT src AS node, count(DISTINCT dst) AS degree FROM b GROUP BY src")
def q36_raw_degree(spark, d):
    return G.both_ways(fact_stream(spark, d).select("src", "dst").distinct()).groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("degree"))


@query(f"WITH {FACT_STREAM_SQL}, b AS (SELECT DISTINCT src, dst FROM facts UNION SELECT dst, src FROM facts), g AS (SELECT src AS node, count(DISTINCT dst) AS degree FROM b GROUP BY src), r AS (SELECT dst AS node, degree, row_number() OVER (ORDER BY degree DESC, dst) AS rank FROM b JOIN g ON g.node = dst WHERE src = 'k_1') SELECT * FROM r WHERE rank <= 21")
def q12_graph_preview(spark, d):
    near = G.both_ways(fact_stream(spark, d).select("src", "dst").distinct()).where("src = 'k_1'").select(F.col("dst").alias("node")).distinct()
    top = near.join(q36_raw_degree(spark, d), "node").orderBy(F.desc("degree"), "node").limit(21)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "node")).cast("long"))


@query(f"WITH {FACT_STREAM_SQL} SELECT at[1:10] AS day, src, count(*) AS n, md5(string_agg(src || rel || dst || episode_id, ',' ORDER BY src || rel || dst || episode_id)) AS facts FROM facts GROUP BY ALL")
def q15_facts_by_day(spark, d):
    line = F.concat("src", "rel", "dst", "episode_id")
    return fact_stream(spark, d).groupBy(F.substring("at", 1, 10).alias("day"), "src").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list(line)), ",")).alias("facts"))


@query(f"WITH {FACT_STREAM_SQL} SELECT episode_id, at FROM facts ORDER BY at DESC, episode_id DESC LIMIT 10 OFFSET 20")
def q18_episode_page(spark, d):
    return fact_stream(spark, d).select("episode_id", "at").orderBy(F.desc("at"), F.desc("episode_id")).offset(20).limit(10)


@query("SELECT doc_id, sha256(lang || chr(10) || text || chr(10) || source)[1:16] AS note_id FROM documents")
def q20_note_id(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat("lang", F.lit("\n"), "text", F.lit("\n"), "source"), 256), 1, 16).alias("note_id"))


@query(f"WITH {FACT_STREAM_SQL} SELECT seq, CASE seq % 3 WHEN 0 THEN at[1:4] || '-01-01' WHEN 1 THEN at[1:10] END AS bound FROM facts")
def q25_day_bound(spark, d):
    given = F.when(F.col("seq") % 3 == 0, F.substring("at", 1, 4)).when(F.col("seq") % 3 == 1, F.substring("at", 1, 10)).otherwise(F.col("rel"))
    return fact_stream(spark, d).select("seq", X.day_bound(given).alias("bound"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(0.0, least(1.0, value / 200)) END AS lambda FROM events")
def q26_lambda(spark, d):
    v = F.col("value") / 200
    return table(spark, d, "events").select("event_id", F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).alias("lambda"))


@query(f"WITH {FACT_STREAM_SQL} SELECT 'out' AS way, rel, dst AS other, seq FROM facts WHERE src = 'k_1' UNION ALL SELECT 'in', rel, src, seq FROM facts WHERE dst = 'k_1'")
def q34_entity_facts(spark, d):
    f = fact_stream(spark, d)
    return f.where("src = 'k_1'").select(F.lit("out").alias("way"), "rel", F.col("dst").alias("other"), "seq").unionByName(f.where("dst = 'k_1'").select(F.lit("in").alias("way"), "rel", F.col("src").alias("other"), "seq"))


# ---- erasure

_SECRET = "und den"
_STOPS = ", ".join(f"'{w}'" for w in X.REDACTION_STOPWORDS)
_OWN = f"list_distinct([x FOR x IN regexp_extract_all(lower(s), '[a-z0-9'']+') IF x NOT IN ({_STOPS})])"
_HIT = f"s AS (SELECT doc_id, unnest({_SENTENCES.format('text')}) AS s, generate_subscripts({_SENTENCES.format('text')}, 1) AS i FROM documents), c AS (SELECT *, len(list_intersect({_OWN}, ['und', 'den'])) AS c, len({_OWN}) AS n FROM s), h AS (SELECT doc_id, s, i, contains(lower(s), '{_SECRET}') OR (c >= 2 AND c >= 1.6 AND c >= 0.5 * n) AS hit FROM c)"


@query(f"WITH {FACT_STREAM_SQL} SELECT seq, src, rel, dst, seq % 7 <> 0 AS valid, CASE WHEN seq % 7 <> 0 THEN 'asserted' ELSE 'retracted' END AS belief FROM facts")
def f01_tombstone(spark, d):
    f = fact_stream(spark, d)
    return S.tombstone(f, f.where("seq % 7 = 0").select("episode_id")).select("seq", "src", "rel", "dst", "valid", "belief")


@query(f"WITH {FACT_STREAM_SQL}, n AS (SELECT src AS id FROM facts UNION SELECT dst FROM facts), v AS (SELECT * FROM facts WHERE src NOT IN ('user_3', 'user_7') AND seq % 4 = 0) SELECT id FROM n WHERE id NOT IN (SELECT src FROM v UNION SELECT dst FROM v)")
def f04_orphans(spark, d):
    f = fact_stream(spark, d)
    nodes = f.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return S.orphans(nodes, S.tombstone(f, f.where("src in ('user_3', 'user_7') or seq % 4 <> 0").select("episode_id")))


@query(f"WITH {_HIT} SELECT doc_id, count(*) FILTER (hit) AS n_hits FROM h GROUP BY doc_id")
def f05_sweep(spark, d):
    marks = S.secret_marks(F.col("text"), F.lit(_SECRET))
    docs = table(spark, d, "documents").select("doc_id", marks.alias("marks"))
    return docs.where(F.size("marks") > 0).select("doc_id", F.size(F.filter("marks", lambda m: m)).cast("long").alias("n_hits"))


@query(f"WITH {_HIT} SELECT doc_id, CASE WHEN count(*) FILTER (NOT hit) > 0 THEN md5(string_agg(CASE WHEN hit THEN '[redacted]' ELSE s END, ' ' ORDER BY i)) END AS kept FROM h GROUP BY doc_id")
def f06_redact(spark, d):
    docs = table(spark, d, "documents").where(F.size(X.sentences(F.col("text"))) > 0)
    return docs.select("doc_id", F.md5(S.redact(F.col("text"), F.lit(_SECRET))).alias("kept"))


@query(f"SELECT conv_id, turn, len(list_distinct([x FOR x IN regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') IF x NOT IN ({_STOPS})]))::BIGINT AS n FROM conversations")
def f12_redaction_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(X.redaction_tokens(F.col("text"))).cast("long").alias("n"))
