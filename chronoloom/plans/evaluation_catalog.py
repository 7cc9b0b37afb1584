"""Queries on chunks, evaluation and observation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import chunking as CH
from chronoloom.functions import metrics as M
from chronoloom.functions import text as X
from chronoloom.operators import evaluation as EV
from chronoloom.operators.chunks import chunked
from chronoloom.plans.context_catalog import _RK, _ranked
from chronoloom.plans.extract_catalog import _pick, _picked
from chronoloom.plans.registry import query
from chronoloom.sources import episode_graph as EG
from chronoloom.sources.episode_graph import GRAPH_SQL
from chronoloom.sources.tables import table

# ---- chunks

_UNITS = "u AS (SELECT doc_id, i, u FROM (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, [trim(x) FOR x IN string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)) IF trim(x) <> ''] AS l FROM documents)))"


@query(f"WITH RECURSIVE {_UNITS}, r AS (SELECT doc_id, 1 AS i, length(u)::BIGINT AS buf, 1::BIGINT AS chunk FROM u WHERE i = 1 UNION ALL SELECT r.doc_id, r.i + 1, CASE WHEN buf + length(u) + 1 > 1200 THEN length(u) ELSE buf + length(u) + 1 END, CASE WHEN buf + length(u) + 1 > 1200 THEN chunk + 1 ELSE chunk END FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1), a AS (SELECT r.doc_id, chunk, string_agg(u, chr(10) ORDER BY r.i) AS c FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i GROUP BY ALL) SELECT doc_id, chunk - 1 AS pos, md5(c) AS part FROM a")
def c03_greedy_pack(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(CH.packed(X.sentences(F.col("text")), 1200)).alias("pos", "part"))
    return parts.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("part").alias("part"))


_NL = "[x FOR x IN string_split(text, chr(10)) IF trim(x) <> '']"


@query(f"SELECT doc_id, CASE WHEN len([x FOR x IN {_NL} IF regexp_matches(x, '^(User|Assistant): ')]) >= 2 THEN 'turns' WHEN len([x FOR x IN {_NL} IF regexp_matches(x, '^#{{1,6}} +[^ ]')]) > 0 THEN 'markdown' ELSE 'other' END AS mode FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'User: ' || replace(text, chr(10), ' ') || chr(10) || 'Assistant: yes' WHEN 1 THEN '# ' || text ELSE text END AS text FROM documents)")
def c05_format(spark, d):
    one = F.concat(F.lit("User: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nAssistant: yes"))
    t = F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    mode = CH.format_of(t)
    return table(spark, d, "documents").select("doc_id", F.when(mode.isin("turns", "markdown"), mode).otherwise("other").alias("mode"))


@query("WITH RECURSIVE p AS (SELECT doc_id, length(text) * 1 AS n, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS l FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) > 2400), u AS (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM p), r AS (SELECT doc_id, 1 AS i, length(u)::BIGINT AS buf, 1::BIGINT AS chunk FROM u WHERE i = 1 UNION ALL SELECT r.doc_id, r.i + 1, CASE WHEN buf + length(u) + 2 > 1200 THEN length(u) ELSE buf + length(u) + 2 END, CASE WHEN buf + length(u) + 2 > 1200 THEN chunk + 1 ELSE chunk END FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1) SELECT doc_id, max(chunk) AS n FROM r GROUP BY doc_id HAVING max(chunk) > 1")
def c09_prose(spark, d):
    wide = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    n = F.size(CH.prose_chunks(wide, 1200, 2400))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n")).where("n > 0")


@query()
def c12_chunk_dispatch(spark, d):
    return chunked(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).groupBy("id", "mode").agg(F.count("*").alias("n"), F.max(F.length("chunk")).alias("longest"))


@query()
def c04_turn_chunks(spark, d):
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")
    chats = table(spark, d, "conversations").where("role in ('user', 'assistant')").groupBy(F.col("conv_id").alias("id")).agg(turns.alias("text"))
    return chunked(chats, "turns").groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("size"))


@query(f"WITH RECURSIVE {_UNITS}, w AS (SELECT doc_id, i, len(string_split_regex(u, '\\s+')) AS n FROM u), r AS (SELECT doc_id, i, n::BIGINT AS buf, 1::BIGINT AS chunk FROM w WHERE i = 1 UNION ALL SELECT r.doc_id, r.i + 1, CASE WHEN buf >= 160 THEN n ELSE buf + n END, CASE WHEN buf >= 160 THEN chunk + 1 ELSE chunk END FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1) SELECT doc_id, max(chunk) AS n FROM r GROUP BY doc_id")
def c17_sentence_windows(spark, d):
    s = X.sentences(F.col("text"))
    return table(spark, d, "documents").where(F.size(s) > 0).select("doc_id", F.size(CH.sentence_windows(s)).cast("long").alias("n"))


# ---- evaluation

_GOLD = "gd AS (SELECT query_id, id FROM rk WHERE doc_id % 3 = 0)"
_PER = f"{_RK}, {_GOLD}, h AS (SELECT rk.query_id, count(*) AS hits, min(rank) AS best FROM rk JOIN gd USING (query_id, id) WHERE rank <= 5 GROUP BY ALL), t AS (SELECT query_id, count(*) AS gold FROM gd GROUP BY ALL), s AS (SELECT query_id, count(*) AS shown FROM rk WHERE rank <= 5 GROUP BY ALL)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).where("doc_id % 3 = 0").select("query_id", "id")


@query(f"WITH {_PER} SELECT query_id, round(coalesce(hits, 0) / shown, 3) AS precision, round(coalesce(hits, 0) / gold, 3) AS recall, best, coalesce(hits, 0) > 0 AS hit FROM t LEFT JOIN h USING (query_id) LEFT JOIN s USING (query_id)")
def e07_score_queries(spark, d):
    return EV.score_queries(_ranked(spark, d).select("query_id", "id", "rank"), _gold(spark, d), 8, 5).withColumn("best", F.col("best").cast("long"))


@query(f"WITH {_RK}, m AS (SELECT 'm' || (doc_id % 3) AS mode, 'k' || (query_id % 4) AS kind, (doc_id % 5) / 4.0 AS recall, 1.0 / (1 + doc_id % 7) AS mrr FROM rk) SELECT mode, kind, count(*) AS n, round(avg(recall), 3) AS recall, round(avg(mrr), 3) AS mrr FROM m GROUP BY ROLLUP (mode, kind) HAVING mode IS NOT NULL")
def e03_modes(spark, d):
    r = _ranked(spark, d)
    m = r.select(F.concat(F.lit("m"), F.col("doc_id") % 3).alias("mode"), F.concat(F.lit("k"), F.col("query_id") % 4).alias("kind"), ((F.col("doc_id") % 5) / 4).alias("recall"), (1.0 / (1 + F.col("doc_id") % 7)).alias("mrr"))
    return EV.mode_scores(m)


@query("WITH w AS (SELECT doc_id, [x FOR x, i IN l IF list_position(l, x) = i][1:12] AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS l FROM documents)) SELECT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w, ' ') END AS question FROM w")
def e04_lead_words(spark, d):
    return table(spark, d, "documents").select("doc_id", EV.lead_words(F.col("text")).alias("question"))


@query(f"WITH {GRAPH_SQL}, c AS (SELECT name, count(DISTINCT doc_id) AS n FROM en JOIN ep USING (doc_id) WHERE valid GROUP BY name HAVING count(DISTINCT doc_id) >= 2) SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS place FROM c ORDER BY place LIMIT 50")
def e05_entity_questions(spark, d):
    ep = EG.episodes(spark, d).where("valid").select("doc_id")
    top = EG.entities(spark, d).join(ep, "doc_id").groupBy("name").agg(F.countDistinct("doc_id").alias("n")).where("n >= 2").orderBy(F.desc("n"), "name").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "name")).cast("long"))


@query("SELECT doc_id, source || '.' || doc_id AS article FROM documents")
def e06_article(spark, d):
    node = F.concat(F.when(F.col("doc_id") % 2 == 0, "ep_").otherwise("obj_"), "source", F.lit("."), "doc_id", F.lit("#c003"))
    return table(spark, d, "documents").select("doc_id", M.article(node).alias("article"))


_WANT = "list_distinct([x FOR x IN regexp_extract_all(lower(coalesce(w, '')), '[a-z0-9]+') IF length(x) > 1])"


@query(f"WITH p AS (SELECT a.conv_id, a.turn, CASE WHEN a.turn % 3 = 0 THEN (a.conv_id % 7)::VARCHAR ELSE a.text END AS w, 'about ' || (a.conv_id % 5) || ' ' || coalesce(b.text, '') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN conv_id % 7 = conv_id % 5 END AS number_right, CASE WHEN len({_WANT}) > 0 THEN round(len(list_intersect({_WANT}, regexp_extract_all(lower(h), '[a-z0-9]+'))) / len({_WANT}), 3) END AS recall FROM p")
def e08_response_proxy(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    want = F.when(F.col("turn") % 3 == 0, (F.col("conv_id") % 7).cast("string")).otherwise(F.col("text"))
    p = M.response_proxy(F.concat(F.lit("about "), F.col("conv_id") % 5, F.lit(" "), F.coalesce("reply", F.lit(""))), want)
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", p["number_right"].alias("number_right"), p["recall"].alias("recall"))


@query(f"WITH {_PER} SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'unscored' WHEN query_id % 5 = 1 THEN 'ok' WHEN coalesce(hits, 0) = 0 THEN 'not_found' WHEN best > 2 THEN 'not_in_context' WHEN coalesce(hits, 0) < gold THEN 'partial' ELSE 'reader' END AS bucket FROM t LEFT JOIN h USING (query_id)")
def e11_triage(spark, d):
    s = EV.score_queries(_ranked(spark, d).select("query_id", "id", "rank"), _gold(spark, d), 5, 5)
    right = F.when(F.col("query_id") % 5 != 0, F.col("query_id") % 5 == 1)
    return s.select("query_id", M.triage(F.col("recall"), F.coalesce(F.col("best") <= 2, F.lit(False)), F.col("hit"), right).alias("bucket"))


@query(f"WITH {GRAPH_SQL}, g AS (SELECT doc_id, id FROM ep WHERE doc_id % 3 = 0) SELECT id, (SELECT count(*) FROM en WHERE en.doc_id = g.doc_id) AS entities, (SELECT count(*) FROM fx WHERE fx.doc_id = g.doc_id) AS facts, (SELECT count(*) FROM fx WHERE fx.doc_id = g.doc_id AND invalid_at <> '') AS dated FROM g")
def e12_gold_yields(spark, d):
    g = EG.episodes(spark, d).where("doc_id % 3 = 0").select("doc_id", "id")
    en = EG.entities(spark, d).groupBy("doc_id").agg(F.count("*").alias("entities"))
    fx = EG.facts(spark, d).groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("invalid_at") != "").alias("dated"))
    return g.join(en, "doc_id", "left").join(fx, "doc_id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entities", "facts", "dated")])


@query(f"WITH {_RK} SELECT source, count(*) AS n FROM rk GROUP BY source")
def e14_bucket_counts(spark, d):
    return EV.counted(_ranked(spark, d), "source")


@query(f"WITH {GRAPH_SQL} SELECT count(DISTINCT tag) AS vocabulary, round(count(*) / (SELECT count(*) FROM ep), 3) AS mean FROM tg")
def e17_tag_average(spark, d):
    n = EG.episodes(spark, d).agg(F.count("*").alias("n"))
    return EG.tags(spark, d).agg(F.countDistinct("tag").alias("vocabulary"), F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("vocabulary", F.round(F.col("c") / F.col("n"), 3).alias("mean"))


@query(f"WITH {GRAPH_SQL} SELECT 'entity_' || name AS node, min(doc_id) AS appears, count(DISTINCT doc_id) AS n_steps FROM en GROUP BY name")
def e18_appearances(spark, d):
    return EV.appearances(EG.entities(spark, d).select(F.concat(F.lit("entity_"), "name").alias("node"), F.col("doc_id").alias("step")))


ASKED = ["How many cats?", "what is the total?", "how much did both cost", "Where is it?", "count them", "In total, how many", "somehow many"]
_PAD = "' ' || regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g') || ' '"
_SUM = "(" + " OR ".join(f"contains({_PAD}, ' {w} ')" for w in M.SUM_WORDS) + ")"
_CNT = "(" + " OR ".join(f"contains({_PAD}, ' {w} ')" for w in M.COUNT_WORDS) + ")"


@query(f"SELECT id, {_SUM} OR {_CNT} AS aggregate FROM {_picked(ASKED, 't')}")
def e21_is_aggregate(spark, d):
    return _pick(spark, d, ASKED, "t").select("id", M.is_aggregate(F.col("t")).alias("aggregate"))


@query(f"SELECT id, CASE WHEN {_SUM} THEN 'sum' WHEN {_CNT} THEN 'count' ELSE 'other' END AS shape FROM {_picked(ASKED, 't')}")
def e22_question_shape(spark, d):
    return _pick(spark, d, ASKED, "t").select("id", M.question_shape(F.col("t")).alias("shape"))


MONEY = ["paid $1,300.00 and 20 dollars", "$5.50, then $5.5", "no money", "12.00 dollars for 3 cats", "$ 7 or $70"]
WANT = [["1300", "20"], ["5.5"], [], ["12"], ["7", "70"]]


@query("SELECT id, array_to_string((" + repr([",".join(w) for w in WANT]) + "::VARCHAR[])[id % 5 + 1:id % 5 + 1], ',') AS amounts FROM (SELECT p_partkey AS id FROM part)")
def e24_amounts(spark, d):
    return _pick(spark, d, MONEY, "t").select("id", F.array_join(M.amounts(F.col("t")), ",").alias("amounts"))


@query("SELECT DISTINCT unnest(['1300', '20', '5.5', '12', '7', '70']) AS amount")
def e25_node_amounts(spark, d):
    return _pick(spark, d, MONEY, "t").select(F.explode(M.amounts(F.col("t"))).alias("amount")).distinct()


@query("SELECT id, CASE id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.0 END AS rate FROM (SELECT p_partkey AS id FROM part)")
def e26_capture_rate(spark, d):
    a, known = M.amounts(F.col("t")), F.array(F.lit("20"), F.lit("12"))
    return _pick(spark, d, MONEY, "t").select("id", F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, known)) / F.size(a), 3)).alias("rate"))


@query("WITH r AS (SELECT * FROM (VALUES (0, 2, 1), (1, 1, 0), (3, 1, 1), (4, 2, 0)) v(k, n, c)), p AS (SELECT p_partkey % 5 AS k FROM part) SELECT count(*) AS questions, sum(n)::BIGINT AS amounts, round(sum(c) / sum(n), 3) AS rate FROM p JOIN r USING (k)")
def e27_tier1(spark, d):
    a, known = M.amounts(F.col("t")), F.array(F.lit("20"), F.lit("12"))
    rows = _pick(spark, d, MONEY, "t").select(F.size(a).alias("n"), F.size(F.array_intersect(a, known)).alias("c")).where("n > 0")
    return rows.agg(F.count("*").alias("questions"), F.sum("n").alias("amounts"), F.round(F.sum("c") / F.sum("n"), 3).alias("rate"))


_OCC = "oc AS (SELECT doc_id % 20 AS query_id, doc_id AS occ FROM documents), mt AS (SELECT query_id, occ, 'n' || (occ % 70) AS node FROM oc WHERE occ % 4 <> 1), f AS (SELECT query_id, occ, min(node) AS node FROM mt GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY query_id, node) AS claims FROM f), st AS (SELECT oc.query_id, oc.occ, CASE WHEN node IS NULL THEN 'MISSING' WHEN claims > 1 THEN 'COLLAPSED' ELSE 'CAPTURED' END AS state FROM oc LEFT JOIN c USING (query_id, occ))"


def _states(spark: SparkSession, d: str) -> DataFrame:
    oc = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("occ"))
    return EV.classified(oc, oc.where("occ % 4 <> 1").withColumn("node", F.concat(F.lit("n"), F.col("occ") % 70)))


@query(f"WITH {_OCC} SELECT * FROM st")
def e28_classify(spark, d):
    return _states(spark, d)


@query(f"WITH {_OCC} SELECT CASE WHEN query_id % 2 = 0 THEN 'sum' ELSE 'count' END AS shape, count(*) AS n, count(*) FILTER (state = 'CAPTURED') AS captured, count(*) FILTER (state = 'COLLAPSED') AS collapsed, count(*) FILTER (state = 'MISSING') AS missing, round(count(*) FILTER (state = 'CAPTURED') / count(*), 3) AS share FROM st GROUP BY ROLLUP (shape)")
def e31_tier2(spark, d):
    return EV.tier_summary(_states(spark, d).withColumn("shape", F.when(F.col("query_id") % 2 == 0, "sum").otherwise("count")))


@query(f"SELECT id, k IN (0, 1, 3) AS hit FROM (SELECT p_partkey AS id, p_partkey % 5 AS k FROM part)")
def e29_occurrence_match(spark, d):
    label = F.get(F.array(*[F.lit(x) for x in ("dollars", "then", "dog house", "three cats", "euro")]), (F.col("id") % 5).cast("int"))
    return _pick(spark, d, MONEY, "t").select("id", M.matches(F.col("t"), label, F.lit(None).cast("string")).alias("hit"))


@query("SELECT event_type AS site, count(*) AS calls, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def e43_cost_by_site(spark, d):
    return EV.summed(table(spark, d, "events").withColumnRenamed("event_type", "site"), ["site"], ["value"], 4)


@query("SELECT count(*) AS calls, round(sum(value), 4) AS value, round(sum(value * 2), 4) AS twice FROM events")
def e33_usage_totals(spark, d):
    return EV.summed(table(spark, d, "events").withColumn("twice", F.col("value") * 2), [], ["value", "twice"], 4)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, l_partkey - l_suppkey - l_linenumber) AS fresh, l_suppkey AS cached, l_linenumber::BIGINT AS written FROM lineitem")
def e34_usage_fields(spark, d):
    u = M.usage_fields(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", u["fresh"].alias("fresh"), u["cached"].alias("cached"), u["written"].alias("written"))


@query("SELECT l_returnflag AS label, count(*) AS calls, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY l_returnflag")
def e36_profile_merge(spark, d):
    return EV.summed(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "label"), ["label"], ["l_quantity"], 2)


@query("SELECT doc_id AS id, lang AS kind, CASE WHEN toxic IS NULL THEN 'missing' WHEN quality = 1 AND doc_id % 3 <> 0 THEN 'same' WHEN quality = 0 AND doc_id % 3 <> 0 THEN 'gain' WHEN quality = 1 THEN 'loss' WHEN doc_id % 2 = 0 THEN 'READER' ELSE 'RETRIEVAL' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def e37_runs_compared(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    a = j.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), (F.col("quality") == 1).alias("correct"))
    b = j.where("toxic is not null").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 != 0).alias("correct"), ((F.col("doc_id") + 1) % 2).alias("found"))
    return EV.compared(a, b)


@query(f"WITH {GRAPH_SQL}, t AS (SELECT doc_id, string_agg(tag, ',' ORDER BY pos) AS tags FROM tg GROUP BY doc_id), e AS (SELECT doc_id, string_agg(name, ',' ORDER BY pos) AS entities FROM en WHERE pos <= 4 GROUP BY doc_id), r AS (SELECT doc_id, string_agg(rel, ',' ORDER BY seq) AS relations FROM fx WHERE seq % 10 <= 2 GROUP BY doc_id) SELECT doc_id, tags, entities, relations FROM t FULL JOIN e USING (doc_id) FULL JOIN r USING (doc_id)")
def e40_footprint(spark, d):
    tg, en = EG.tags(spark, d).withColumnRenamed("tag", "value"), EG.entities(spark, d).withColumnRenamed("name", "value")
    return EV.footprint(tg, en, EG.facts(spark, d).select("doc_id", F.col("seq").alias("pos"), F.col("rel").alias("value")), (14, 4, 2))


@query(f"SELECT a.conv_id, a.turn, CASE WHEN len({_WANT.replace('w,', 'a.text,')}) > 0 THEN round(len(list_intersect({_WANT.replace('w,', 'a.text,')}, regexp_extract_all(lower(coalesce(b.text, '')), '[a-z0-9]+'))) / len({_WANT.replace('w,', 'a.text,')}), 3) END AS share FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def e41_evidence_fraction(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", M.evidence_share(F.col("text"), F.col("reply")).alias("share"))


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT substr(x, 8) AS name FROM (SELECT unnest([src, dst]) AS x FROM fx)")
def e44_fact_names(spark, d):
    return EG.facts(spark, d).select(F.explode(F.array("src", "dst")).alias("x")).select(F.regexp_replace("x", "^entity_", "").alias("name")).distinct()


@query("SELECT o_orderkey AS run_id, round(o_totalprice + o_orderkey % 2, 2) AS at FROM orders")
def e46_index_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("at"))
    new = o.where("run_id % 2 = 1").withColumn("at", F.col("at") + 1)
    return EV.index_upsert(o, new).select("run_id", F.round("at", 2).alias("at"))


@query()
def e30_occurrence_dedup(spark, d):
    oc = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("occ"), F.substring("text", 1, 60).alias("label"))
    return EV.deduplicated(oc.where("label is not null"))
