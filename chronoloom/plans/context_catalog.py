"""Queries on seeding, ranking, context assembly and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import context as C
from chronoloom.operators import graph_store as GS
from chronoloom.operators.ranking import lane
from chronoloom.plans.extract_catalog import _pick, _picked
from chronoloom.plans.registry import query
from chronoloom.sources import episode_graph as EG
from chronoloom.sources.episode_graph import GRAPH_SQL
from chronoloom.sources.tables import table

_RK = "rk AS (SELECT doc_id % 20 AS query_id, 'ep_' || doc_id AS id, doc_id, source, text, strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY md5('x' || doc_id)) AS rank FROM documents)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers to twenty questions, in an order without meaning."""
    ep = EG.episodes(spark, d).withColumn("query_id", F.col("doc_id") % 20)
    order = Window.partitionBy("query_id").orderBy(F.md5(F.concat(F.lit("x"), "doc_id")))
    return ep.select("query_id", "id", "doc_id", "source", "text", "day", F.row_number().over(order).alias("rank"))


PHRASES = ["what about yesterday", "3 weeks ago I moved", "last tuesday", "last month", "two days ago", "a year ago", "last sunday we met", "nothing", "10 months ago", "last year"]
_DAY = "(DATE '2024-03-01' + (id % 50)::INT)"
_U = "regexp_extract(text, '(^|[^a-z0-9])([0-9]{1,4}|an?|two) (day|week|month|year)s? ago', 3)"
_N = "CASE regexp_extract(text, '(^|[^a-z0-9])([0-9]{1,4}|an?|two) (day|week|month|year)s? ago', 2) WHEN 'a' THEN 1 WHEN 'an' THEN 1 WHEN 'two' THEN 2 ELSE TRY_CAST(regexp_extract(text, '(^|[^a-z0-9])([0-9]{1,4}|an?|two) (day|week|month|year)s? ago', 2) AS INT) END"
_BACK = f"bk AS (SELECT id, text, {_DAY} AS day, CASE WHEN text LIKE '%last tuesday%' THEN (isodow({_DAY}) - 1 - 1 + 6) % 7 + 1 WHEN text LIKE '%last sunday%' THEN (isodow({_DAY}) - 1 - 6 + 6 + 7) % 7 + 1 WHEN {_U} <> '' THEN {_N} * CASE {_U} WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 365 END WHEN text LIKE '%yesterday%' THEN 1 WHEN text = 'last month' THEN 30 WHEN text = 'last year' THEN 365 END AS days, CASE WHEN text LIKE '%last tuesday%' OR text LIKE '%last sunday%' THEN 1 WHEN {_U} <> '' THEN CASE {_U} WHEN 'day' THEN 1 WHEN 'week' THEN 3 WHEN 'month' THEN 10 ELSE 45 END WHEN text LIKE '%yesterday%' THEN 0 WHEN text = 'last month' THEN 12 WHEN text = 'last year' THEN 45 END AS slack, {_U} = 'day' OR text LIKE '%yesterday%' AS exact FROM {_picked(PHRASES, 'text')})"


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    return _pick(spark, d, PHRASES, "text").withColumn("day", F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 50).cast("int")))


@query(f"WITH {_BACK} SELECT id, strftime(day - (days + slack)::INT, '%Y-%m-%d') AS first, strftime(day - (days - slack)::INT, '%Y-%m-%d') AS last FROM bk")
def r08_relative_window(spark, d):
    w = C.relative_window(F.col("text"), F.col("day"))
    return _phrases(spark, d).select("id", w["first"].cast("string").alias("first"), w["last"].cast("string").alias("last"))


@query(f"WITH {_BACK} SELECT id, strftime(day - days::INT, '%Y-%m-%d') AS meant, CASE WHEN days IS NOT NULL THEN exact END AS exact FROM bk")
def b13_relative_phrase(spark, d):
    back = C.days_back(F.col("text"), F.col("day"))
    return _phrases(spark, d).select("id", F.date_sub("day", back["days"]).cast("string").alias("meant"), back["exact"].alias("exact"))


@query(f"WITH {_BACK} SELECT id, CASE WHEN days IS NULL THEN text ELSE text || CASE WHEN exact THEN ' [= ' ELSE ' [≈ ' END || strftime(day - days::INT, '%Y-%m-%d') || ']' END AS text FROM bk")
def b12_annotate(spark, d):
    return _phrases(spark, d).select("id", C.annotated(F.col("text"), F.col("day")).alias("text"))


@query(f"WITH {_RK} SELECT doc_id, CASE WHEN n = 0 THEN '(' || day || ', same day)' ELSE '(' || day || ', ' || abs(n) || CASE WHEN abs(n) = 1 THEN ' day ' ELSE ' days ' END || CASE WHEN n > 0 THEN 'before' ELSE 'after' END || ' the question)' END AS shown FROM (SELECT *, DATE '2024-01-15' - day::DATE AS n FROM rk)")
def b11_date_delta(spark, d):
    return _ranked(spark, d).select("doc_id", C.when_with_delta(F.col("day").cast("date"), F.lit("2024-01-15").cast("date")).alias("shown"))


_GRAM = "w AS (SELECT item_id, [x FOR x IN string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+') IF x <> ''] AS w FROM benchmark), g AS (SELECT item_id, unnest(list_concat(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS s FROM w)"
_SING = "CASE WHEN length({0}) <= 4 THEN {0} WHEN {0} LIKE '%ies' THEN {0}[:-4] || 'y' WHEN {0} LIKE '%es' AND NOT ({0} LIKE '%ses' OR {0} LIKE '%zes') THEN {0}[:-3] WHEN {0} LIKE '%s' AND NOT {0} LIKE '%ss' THEN {0}[:-2] ELSE {0} END"


@query(f"WITH {GRAPH_SQL}, {_GRAM}, k AS (SELECT {_SING.format('name')} AS key, min(id) AS id FROM ty GROUP BY 1), a AS (SELECT DISTINCT item_id, {_SING.format('s')} AS key FROM g WHERE NOT contains(s, ' ')) SELECT DISTINCT item_id AS query_id, id FROM a JOIN k USING (key)")
def r02_key_lookup(spark, d):
    from chronoloom.functions.keys import surface_key

    keys = EG.entity_types(spark, d).groupBy(surface_key(F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    return C.key_hits(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), keys)


@query(f"WITH {GRAPH_SQL}, {_RK}, l AS (SELECT query_id, id, 1.0 / rank AS score FROM rk UNION ALL SELECT query_id, id, 0.6 * (doc_id % 10) / 10 FROM rk UNION ALL SELECT (query_id + 1) % 20, id, 0.7 * 0.5 FROM rk WHERE rank <= 5) SELECT query_id, id, round(max(score), 6) AS score FROM l WHERE id IN (SELECT id FROM ep WHERE valid) GROUP BY query_id, id")
def r01_seed_fusion(spark, d):
    r = _ranked(spark, d)
    lists = [
        (r.select("query_id", "id", (1.0 / F.col("rank")).alias("score")), 1.0), (r.select("query_id", "id", (F.col("doc_id") % 10 / 10).alias("score")), 0.6),
        (r.where("rank <= 5").select(((F.col("query_id") + 1) % 20).alias("query_id"), "id", F.lit(0.5).alias("score")), 0.7),
    ]
    return C.fused_seeds(lists, EG.episodes(spark, d).where("valid")).withColumn("score", F.round("score", 6))


_MASS = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 4 END"


@query(f"WITH {_RK}, b AS (SELECT query_id, id, round(1.0 / (1 + doc_id % 13) * (1 + 1 / (1 + coalesce({_MASS}, 6))), 6) AS base FROM rk) SELECT query_id, id, base, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, id) AS rank FROM b")
def r04_boosted_sort(spark, d):
    dist = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 4)
    rows = _ranked(spark, d).select("query_id", "id", (1.0 / (1 + F.col("doc_id") % 13)).alias("score"), dist.alias("dist"))
    return C.boosted(rows).select("query_id", "id", "base", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RK}, m AS (SELECT query_id, 'ep_' || ((doc_id + 7) % 50) AS id FROM rk WHERE rank <= 4), p AS (SELECT query_id, id, rank FROM rk WHERE rank <= 6), n AS (SELECT DISTINCT query_id, id FROM m WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM p)) SELECT query_id, id, rank FROM p UNION ALL SELECT n.query_id, id, c + row_number() OVER (PARTITION BY n.query_id ORDER BY id) FROM n JOIN (SELECT query_id, max(rank) AS c FROM p GROUP BY query_id) USING (query_id)")
def r10_augment(spark, d):
    r = _ranked(spark, d)
    more = r.where("rank <= 4").select("query_id", F.concat(F.lit("ep_"), (F.col("doc_id") + 7) % 50).alias("id"))
    return C.augmented(r.where("rank <= 6").select("query_id", "id", "rank"), more).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_RK}, t AS (SELECT query_id, id, rank FROM rk WHERE rank <= 5), p AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS rank FROM rk), w AS (SELECT * FROM p WHERE rank <= 3), x AS (SELECT w.* FROM w WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM t)), c AS (SELECT query_id, count(*) AS n FROM x GROUP BY query_id), b AS (SELECT t.*, coalesce(n, 0) AS n, (t.query_id, t.id) IN (SELECT (query_id, id) FROM w) AS wanted FROM t LEFT JOIN c USING (query_id)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY wanted, rank DESC) AS back FROM b), e AS (SELECT query_id, id, 0 AS o, rank FROM k WHERE wanted OR back > n UNION ALL SELECT query_id, id, 1, rank FROM x) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, rank) AS rank FROM e")
def r13_guarantee(spark, d):
    r = _ranked(spark, d).select("query_id", "id", "rank")
    first = r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"))))
    return C.guaranteed(r, first, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_RK}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS f FROM rk), l AS (SELECT *, f AND sum(f::INT) OVER (PARTITION BY query_id ORDER BY rank) <= 3 AS l FROM s) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY l DESC, rank) AS place FROM l")
def r14_session_dedup(spark, d):
    return C.sessions_first(_ranked(spark, d), "source", 3).select("query_id", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_RK}, t AS (SELECT * FROM rk WHERE rank <= 3), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n FROM rk WHERE rank > 3 AND (query_id, source) NOT IN (SELECT (query_id, source) FROM t) QUALIFY n <= 2), c AS (SELECT query_id, count(*) AS c FROM n GROUP BY query_id) SELECT t.query_id, id, rank FROM t LEFT JOIN c USING (query_id) WHERE rank <= 3 - coalesce(c, 0) UNION ALL SELECT n.query_id, id, 3 - c + n FROM n JOIN c USING (query_id)")
def r15_reserved_slots(spark, d):
    r = _ranked(spark, d)
    return C.reserved(r, r.where("rank > 3").select("query_id", "id", "source", "rank"), "source", 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_RK} SELECT query_id, id, rank FROM rk")
def r16_rerank_offline(spark, d):
    return C.reranked(_ranked(spark, d).select("query_id", "id", F.col("rank").cast("long").alias("rank")))


@query(f"WITH {_RK}, c AS (SELECT *, length(text) % 17 AS ce FROM rk WHERE rank <= 8) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY ce DESC, rank) AS rank FROM c")
def r25_scored_rerank(spark, d):
    r = _ranked(spark, d).where("rank <= 8")
    ce = r.select("query_id", "id", (F.length("text") % 17).alias("ce"))
    return C.reranked(r.select("query_id", "id", "rank"), lambda _: ce).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {GRAPH_SQL}, s AS (SELECT doc_id % 20 AS query_id, 'entity_' || name AS id, pos FROM en UNION ALL SELECT doc_id % 20, 'tag_' || tag, pos FROM tg) SELECT DISTINCT query_id, id FROM s WHERE id LIKE 'entity_%'")
def r23_entity_seeds(spark, d):
    q = (F.col("doc_id") % 20).alias("query_id")
    seeds = EG.entities(spark, d).select(q, F.concat(F.lit("entity_"), "name").alias("id")).unionByName(EG.tags(spark, d).select(q, F.concat(F.lit("tag_"), "tag").alias("id")))
    return seeds.join(GS.nodes_of_type(EG.nodes(spark, d), "entity").select("id"), "id", "left_semi").distinct()


@query(f"WITH {_RK} SELECT query_id, id, day FROM rk WHERE day BETWEEN '2024-01-05' AND '2024-01-20'")
def r11_window_filter(spark, d):
    return C.in_window(_ranked(spark, d), "day", "2024-01-05", "2024-01-20").select("query_id", "id", "day")


@query()
def r09_hybrid(spark, d):
    r = _ranked(spark, d)
    lanes = table(spark, d, "conversations").where("turn = 0 and conv_id < 20").select(F.col("conv_id").alias("query_id"), lane(F.col("text")).alias("lane"))
    facts = EG.facts(spark, d).where("belief = 'asserted'").select((F.col("doc_id") % 20).alias("query_id"), F.col("episode_id").alias("id"))
    return C.hybrid(r.where("rank <= 32").select("query_id", "id", "rank"), lanes, EG.episodes(spark, d).select("id", "day"), facts, 8)


_BONUS = "(CASE WHEN regexp_matches(lower(t), '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(lower(t), '[$€£] ?[0-9]|[0-9] ?(dollars|euros|pounds)') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(t), 'yesterday|tomorrow|(last|next) (week|month|year)|[0-9]+ (days|weeks|months|years) ago') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(lower(t), '(^|[^a-z])(two|three|four|five|six|seven|eight|nine|ten) [a-z]') THEN 3 ELSE 0 END)"
PASSAGES = ["paid $30 on 2024-01-02", "two cats and 3 dogs", "yesterday at noon", "nothing", "met 4 weeks ago for 5 euros", "three of them"]


@query(f"SELECT id, {_BONUS} AS bonus FROM {_picked(PASSAGES, 't')}")
def b03_payload_bonus(spark, d):
    return _pick(spark, d, PASSAGES, "t").select("id", C.payload_bonus(F.col("t")).alias("bonus"))


@query(f"SELECT id, len(list_intersect(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')), ['cats', '3', 'noon', '4', 'weeks', '5'])) + 2 * len([x FOR x IN list_intersect(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')), ['cats', '3', 'noon', '4', 'weeks', '5']) IF regexp_full_match(x, '[0-9]+')]) + {_BONUS} AS score FROM {_picked(PASSAGES, 't')}")
def b04_lexical_score(spark, d):
    terms = F.array(*[F.lit(x) for x in ("cats", "3", "noon", "4", "weeks", "5")])
    return _pick(spark, d, PASSAGES, "t").select("id", C.lexical_score(F.col("t"), terms).cast("long").alias("score"))


_CH = "ch AS (SELECT conv_id % 10 AS query_id, conv_id AS base, turn AS ord, length(coalesce(text, '')) AS size, text FROM conversations), se AS (SELECT query_id, base, ord, row_number() OVER (PARTITION BY query_id ORDER BY md5('c' || base || '.' || ord)) AS rank FROM ch QUALIFY rank <= 6)"


def _chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ch = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("query_id"), F.col("conv_id").alias("base"), F.col("turn").alias("ord"), F.length(F.coalesce("text", F.lit(""))).alias("size"), "text")
    order = Window.partitionBy("query_id").orderBy(F.md5(F.concat(F.lit("c"), "base", F.lit("."), "ord")))
    return ch, ch.select("query_id", "base", "ord", F.row_number().over(order).alias("rank")).where("rank <= 6")


@query(f"WITH {_CH}, n AS (SELECT s.query_id, c.base, c.ord, min({{'r': s.rank, 'd': abs(c.ord - s.ord)}}) AS m, any_value(c.size) AS size FROM se s JOIN ch c ON c.base = s.base AND abs(c.ord - s.ord) <= 2 GROUP BY ALL), u AS (SELECT query_id, base, ord, sum(size) OVER (PARTITION BY query_id ORDER BY m.r, m.d, base, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM n) SELECT * FROM u WHERE used <= 3000")
def b07_siblings(spark, d):
    ch, se = _chunks(spark, d)
    return C.siblings(se, ch.select("base", "ord", "size"), 2, 3000)


@query(f"WITH {_CH}, sl AS (SELECT query_id, base, count(*) AS n, min(rank) AS r FROM se GROUP BY ALL), b AS (SELECT c.query_id, c.base, c.ord, n, r, row_number() OVER (PARTITION BY c.query_id, c.base ORDER BY c.size DESC, s.ord IS NULL, c.ord) AS p FROM ch c JOIN sl USING (query_id, base) LEFT JOIN se s ON s.query_id = c.query_id AND s.base = c.base AND s.ord = c.ord) SELECT query_id, base, ord, row_number() OVER (PARTITION BY query_id ORDER BY r, base, ord) AS place FROM b WHERE p <= n")
def b05_retarget(spark, d):
    ch, se = _chunks(spark, d)
    return C.retargeted(se, ch.select("query_id", "base", "ord", F.col("size").alias("score"))).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_CH}, sl AS (SELECT query_id, base, count(*) AS n FROM se GROUP BY ALL) SELECT query_id, base, n FROM sl")
def b06_source_slots(spark, d):
    ch, se = _chunks(spark, d)
    return C.retargeted(se, ch.select("query_id", "base", "ord", F.col("size").alias("score"))).groupBy("query_id", "base").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH_SQL} SELECT src AS chunk, substr(dst, 5) AS source FROM ed WHERE etype = 'PART_OF'")
def b02_source_chunks(spark, d):
    return GS.source_of(EG.edges(spark, d)).select(F.col("episode_id").alias("chunk"), F.regexp_replace("source_id", "^src_", "").alias("source"))


@query(f"WITH {_RK}, c AS (SELECT query_id, id, rank AS place, rank % 2 = 0 AS expanded FROM rk WHERE rank <= 5), s AS (SELECT query_id, id, rank FROM rk WHERE rank IN (2, 7, 9)), n AS (SELECT query_id, arg_min(id, rank) AS id FROM s WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM c) GROUP BY query_id), l AS (SELECT query_id, max(place) AS p FROM c WHERE expanded GROUP BY query_id) SELECT c.query_id, CASE WHEN place = l.p AND n.id IS NOT NULL THEN n.id ELSE c.id END AS id, place FROM c LEFT JOIN n USING (query_id) LEFT JOIN l USING (query_id)")
def b08_promote(spark, d):
    r = _ranked(spark, d)
    context = r.where("rank <= 5").select("query_id", "id", F.col("rank").cast("long").alias("place"), (F.col("rank") % 2 == 0).alias("expanded"))
    return C.promoted(context, r.where("rank in (2, 7, 9)").select("query_id", "id", "rank"))


@query(f"WITH {GRAPH_SQL}, {_RK} SELECT DISTINCT query_id, 'entity_' || name AS id FROM rk JOIN en USING (doc_id) WHERE rank <= 3 UNION SELECT doc_id % 20, 'entity_' || name FROM en WHERE pos = 1")
def b09_relevant_entities(spark, d):
    seeds = EG.entities(spark, d).where("pos = 1").select((F.col("doc_id") % 20).alias("query_id"), F.concat(F.lit("entity_"), "name").alias("id"))
    return C.relevant_entities(seeds, GS.mention_star(EG.edges(spark, d)), _ranked(spark, d).where("rank <= 3"))


@query(f"WITH {_RK}, e AS (SELECT query_id, string_agg('[' || id || '] ' || left(text, 20), chr(10) ORDER BY rank) AS e FROM rk WHERE rank <= 3 GROUP BY query_id), f AS (SELECT query_id, string_agg(id || ' ' || day, chr(10) ORDER BY rank) AS f FROM rk WHERE rank <= 2 AND query_id % 2 = 0 GROUP BY query_id), q AS (SELECT DISTINCT query_id FROM rk) SELECT query_id, md5('QUESTION: q' || query_id || chr(10) || 'AS OF: 2024-02-01' || coalesce(chr(10) || chr(10) || 'EPISODES' || chr(10) || e, '') || coalesce(chr(10) || chr(10) || 'FACTS' || chr(10) || f, '')) AS context FROM q LEFT JOIN e USING (query_id) LEFT JOIN f USING (query_id)")
def b10_blob(spark, d):
    r = _ranked(spark, d)
    q = r.select("query_id").distinct().select("query_id", F.concat(F.lit("q"), "query_id").alias("text"), F.lit("2024-02-01").alias("day"))
    e = r.where("rank <= 3").select("query_id", F.col("rank").alias("place"), F.concat(F.lit("["), "id", F.lit("] "), F.substring("text", 1, 20)).alias("line"))
    f = r.where("rank <= 2 and query_id % 2 = 0").select("query_id", F.col("rank").alias("place"), F.concat("id", F.lit(" "), "day").alias("line"))
    return C.blob(q, e, f).select("query_id", F.md5("context").alias("context"))


@query(f"WITH {_RK} SELECT query_id, md5(string_agg(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 220), chr(10) ORDER BY rank)) AS answer FROM rk WHERE rank <= 2 GROUP BY query_id")
def a02_extractive(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    found = _ranked(spark, d).where("rank <= 2").groupBy("query_id").agg(texts.alias("texts"))
    return found.select("query_id", F.md5(C.extractive(F.array().cast("array<string>"), F.col("texts"))).alias("answer"))


@query(f"WITH {_RK} SELECT query_id, string_agg(id, ',' ORDER BY id) FILTER (rank <= 3) AS kept, string_agg(id, ',' ORDER BY id) FILTER (rank > 3) AS dropped FROM rk WHERE rank <= 5 GROUP BY query_id")
def a03_citations(spark, d):
    r = _ranked(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.col("id")))).alias("raw"), F.collect_list(F.when(F.col("rank") <= 3, F.col("id"))).alias("known"))
    c = C.citations(F.concat("raw", "raw"), F.col("known"))
    return r.select("query_id", F.nullif(F.array_join(c["kept"], ","), F.lit("")).alias("kept"), F.nullif(F.array_join(c["dropped"], ","), F.lit("")).alias("dropped"))


@query("SELECT doc_id, 'Ana left, then came back.' AS bare FROM documents")
def a04_strip_citations(spark, d):
    said = F.concat(F.lit("Ana left [ep_"), "doc_id", F.lit("], then came back (ep_1#c002; ep_2) ."))
    return table(spark, d, "documents").select("doc_id", C.without_citations(said).alias("bare"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 1) THEN 'events' ELSE 'plain' END AS shape FROM conversations")
def a05_answer_shape(spark, d):
    lane_of = F.get(F.array(*[F.lit(x) for x in ("state", "multihop", "single", "recency")]), (F.col("turn") % 4).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", C.answer_shape(lane_of).alias("shape"))
