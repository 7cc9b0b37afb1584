"""Names of all queries with their Spark form and, where SQL can say it, their SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import keys as K
from chronoloom.operators import fact_merge as M
from chronoloom.operators import facts as T
from chronoloom.operators import graph as G
from chronoloom.operators import ranking as R
from chronoloom.plans import context_catalog, evaluation_catalog, extract_catalog, graph_catalog, registry, source_catalog, text_catalog, vector_catalog  # noqa: F401
from chronoloom.plans.registry import query
from chronoloom.sources.tables import FACT_STREAM_SQL, chat_sessions, fact_stream, page_links, table, vectors

AS_OF = "2024-01-15"
_PUNCT = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
_SPACED = "trim(regexp_replace(" + _PUNCT + ", '\\s+', ' ', 'g'))"
_SINGULAR = "CASE WHEN length({0}) <= 4 THEN {0} WHEN {0} LIKE '%ies' THEN {0}[:-4] || 'y' WHEN {0} LIKE '%es' AND NOT ({0} LIKE '%ses' OR {0} LIKE '%zes') THEN {0}[:-3] WHEN {0} LIKE '%s' AND NOT {0} LIKE '%ss' THEN {0}[:-2] ELSE {0} END"
_NAMES = "SELECT p_partkey AS id, p_name || ' ' || p_type || 's' AS name FROM part"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type", F.lit("s")).alias("name"))


# ---- keys and scores of surfaces


@query(f"WITH n AS ({_NAMES}), w AS (SELECT id, string_split({_SPACED.format('name')}, ' ') AS w FROM n), l AS (SELECT id, w, w[len(w)] AS t FROM w) SELECT id, CASE WHEN len(w) = 1 THEN {_SINGULAR.format('t')} ELSE array_to_string(w[1:len(w) - 1], ' ') || ' ' || ({_SINGULAR.format('t')}) END AS key FROM l")
def k01_surface_key(spark, d):
    return _names(spark, d).select("id", K.surface_key(F.col("name")).alias("key"))


@query(f"WITH n AS ({_NAMES}) SELECT id, regexp_replace(regexp_replace(regexp_replace(trim({_PUNCT.format('name')}), '[\\s-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM n")
def k03_relation_name(spark, d):
    return _names(spark, d).select("id", K.relation_name(F.col("name")).alias("name"))


@query()
def k05_relation_key(spark, d):
    return _names(spark, d).select("id", K.relation_key(F.concat(F.lit("is "), "name", F.lit(" of"))).alias("key"))


@query()
def k06_cardinality(spark, d):
    spark_names = [(s, s in K.FUNCTIONAL, s in K.SYMMETRIC) for s in sorted({*K.FUNCTIONAL, *K.SYMMETRIC})]
    return spark.createDataFrame(spark_names, "surface string, functional boolean, symmetric boolean").withColumn("key", K.relation_key(F.col("surface")))


@query(f"WITH n AS (SELECT c_custkey AS id, c_mktsegment || 's, ' || c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'org' ELSE 'thing' END AS kind FROM customer), s AS (SELECT id, kind, name, {_SPACED.format('name')} AS s FROM n), w AS (SELECT *, string_split(s, ' ') AS w FROM s), l AS (SELECT *, w[len(w)] AS t FROM w) SELECT id, CASE WHEN kind <> 'thing' THEN s ELSE array_to_string(w[1:len(w) - 1], ' ') || ' ' || ({_SINGULAR.format('t')}) END AS key FROM l")
def k08_entity_key(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit("s, "), "c_name").alias("name"))
    kind = F.when(F.col("id") % 3 == 0, "person").when(F.col("id") % 3 == 1, "org").otherwise("thing")
    return c.select("id", K.entity_key(F.col("name"), kind).alias("key"))


@query("WITH c AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name), '')) AS c FROM part), n AS (SELECT id, c, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM n) SELECT id, round(-sum(p * log2(p)), 6) AS bits FROM s GROUP BY id")
def k09_char_entropy(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(K.char_entropy(F.col("p_name")), 6).alias("bits"))


@query(f"WITH {FACT_STREAM_SQL}, n AS (SELECT count(DISTINCT src) AS n FROM facts) SELECT dst AS node, count(DISTINCT src) AS df, round(ln(1 + any_value(n) / count(DISTINCT src)), 6) AS idf FROM facts, n GROUP BY dst")
def k25_idf(spark, d):
    f = fact_stream(spark, d)
    total = f.agg(F.countDistinct("src").alias("n"))
    df = f.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("node", "df", F.round(K.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("WITH t AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text) SELECT d.doc_id, t.id AS node_id FROM documents d JOIN t USING (text)")
def k11_first_with_key(spark, d):
    docs = table(spark, d, "documents")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("node_id"))
    return docs.select("doc_id", "text").join(first, "text").select("doc_id", "node_id")


# ---- facts in time

_SCD2 = FACT_STREAM_SQL + """, c AS (SELECT *, lag(dst) OVER (PARTITION BY src, rel ORDER BY at, seq) AS before FROM facts),
 w AS (SELECT src, rel, dst, at AS valid_at, coalesce(lead(at) OVER (PARTITION BY src, rel ORDER BY at, seq), '') AS invalid_at, episode_id, confidence, seq FROM c WHERE before IS NULL OR before <> dst)"""


@query(f"WITH {_SCD2} SELECT * FROM w")
def t05_supersede(spark, d):
    return T.supersede(fact_stream(spark, d))


@query(f"WITH {_SCD2} SELECT src, rel, dst, valid_at, seq FROM w WHERE NOT (valid_at <> '' AND valid_at > '{AS_OF}') AND NOT (invalid_at <> '' AND invalid_at <= '{AS_OF}')")
def t01_active_as_of(spark, d):
    return T.supersede(fact_stream(spark, d)).where(T.active(AS_OF)).select("src", "rel", "dst", "valid_at", "seq")


@query(f"WITH {_SCD2} SELECT src, rel, dst, valid_at, seq FROM w WHERE invalid_at = ''")
def t01_active_now(spark, d):
    return T.supersede(fact_stream(spark, d)).where(T.active(None)).select("src", "rel", "dst", "valid_at", "seq")


@query(f"WITH {_SCD2} SELECT seq, dst FROM w WHERE src = 'user_7' AND rel = 'click' AND invalid_at = ''")
def t02_find_facts(spark, d):
    return T.supersede(fact_stream(spark, d)).where("src = 'user_7' and rel = 'click' and invalid_at = ''").select("seq", "dst")


def _statements(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("seq") % 11 == 0, "ended").when(F.col("seq") % 17 == 0, "retracted").otherwise("asserted")
    return fact_stream(spark, d).withColumns({"status": status, "valid_from": F.when(F.col("seq") % 5 == 0, F.substring("at", 1, 10)).otherwise(""), "valid_to": F.lit("")})


@query(f"WITH {_SCD2}, g AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> dst THEN 1 ELSE 0 END) OVER (PARTITION BY src, rel ORDER BY at, seq) AS run FROM c), n AS (SELECT src, rel, run, any_value(dst) AS dst, min(at) AS valid_at, count(DISTINCT episode_id) - 1 AS n_confirmed, max(confidence) AS confidence FROM g GROUP BY src, rel, run) SELECT src, rel, dst, valid_at, coalesce(lead(valid_at) OVER (PARTITION BY src, rel ORDER BY run), '') AS invalid_at, n_confirmed, confidence FROM n")
def t04_merge_functional(spark, d):
    f = M.merge_facts(fact_stream(spark, d), functional=True, margin=2.0)
    return f.select("src", "rel", "dst", "valid_at", "invalid_at", F.size("confirmed_by").cast("long").alias("n_confirmed"), "confidence")


@query()
def t04_merge_repeatable(spark, d):
    return M.merge_facts(_statements(spark, d))


@query()
def t04_actions(spark, d):
    return M.merge_actions(_statements(spark, d)).groupBy("rel", "action").agg(F.count("*").alias("n"))


@query()
def t13_incident_merge(spark, d):
    return M.merge_facts(_statements(spark, d), functional=True, symmetric=True)


@query(f"WITH {FACT_STREAM_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY at, seq) AS n FROM facts) SELECT src, rel, dst, at AS closed_at, CASE WHEN n = 2 THEN 'close' ELSE 'open_closed' END AS action FROM s WHERE n > 1")
def t06_termination(spark, d):
    n = F.row_number().over(Window.partitionBy("src", "rel", "dst").orderBy("at", "seq"))
    s = fact_stream(spark, d).withColumn("status", F.when(n > 1, "ended").otherwise("asserted"))
    did = M.merge_actions(s, margin=2.0).where("action in ('close', 'open_closed')")
    return did.join(s.select("seq", F.col("at").alias("closed_at")), "seq").select("src", "rel", "dst", "closed_at", "action")


@query(f"WITH {FACT_STREAM_SQL}, s AS (SELECT *, at[1:10] AS day FROM facts WHERE rel = 'click') SELECT src, rel, dst, day AS valid_at, count(DISTINCT episode_id) - 1 AS n_confirmed FROM s GROUP BY ALL")
def t08_repeatable_occurrence(spark, d):
    s = fact_stream(spark, d).where("rel = 'click'").withColumn("valid_from", F.substring("at", 1, 10))
    # an occurrence of a day is confirmed by further statements of that day, if it is the first open one
    days = M.merge_facts(s.withColumn("dst", F.concat("dst", F.lit("@"), "valid_from")), margin=2.0)
    return days.select("src", "rel", F.regexp_replace("dst", "@.*$", "").alias("dst"), "valid_at", F.size("confirmed_by").cast("long").alias("n_confirmed"))


@query(f"WITH {FACT_STREAM_SQL}, s AS (SELECT src, rel, dst, at, row_number() OVER (PARTITION BY src, rel, dst ORDER BY at, seq) AS n FROM facts) SELECT src, rel, dst, max(at) FILTER (n = 2) AS valid_at, max(at) FILTER (n = 1) AS invalid_at FROM s WHERE n <= 2 GROUP BY src, rel, dst HAVING count(*) = 2")
def t09_backfill(spark, d):
    n = F.row_number().over(Window.partitionBy("src", "rel", "dst").orderBy("at", "seq"))
    s = fact_stream(spark, d).withColumn("n", n).where("n <= 2").withColumn("status", F.when(F.col("n") == 1, "ended").otherwise("asserted"))
    return M.merge_facts(s, margin=2.0).where("valid_at <> ''").select("src", "rel", "dst", "valid_at", "invalid_at")


@query(f"WITH {FACT_STREAM_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY at, seq) AS n, count(*) OVER (PARTITION BY src, rel, dst) AS total FROM facts) SELECT src, rel, dst, CASE WHEN total = 1 THEN 'retract_new' ELSE 'retract' END AS action FROM s WHERE n = total")
def t10_retract(spark, d):
    w = Window.partitionBy("src", "rel", "dst")
    s = fact_stream(spark, d).withColumns({"n": F.row_number().over(w.orderBy("at", "seq")), "total": F.count("*").over(w)})
    s = s.withColumn("status", F.when(F.col("n") == F.col("total"), "retracted").otherwise("asserted"))
    return M.merge_actions(s, margin=2.0).where("action like 'retract%'").select("src", "rel", "dst", "action")


@query(f"WITH {FACT_STREAM_SQL}, p AS (SELECT seq, confidence, max(confidence) OVER (PARTITION BY src, rel ORDER BY at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM facts) SELECT seq, coalesce(confidence < stored - 0.3, false) AS gated FROM p")
def t11_gate(spark, d):
    before = Window.partitionBy("src", "rel").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return fact_stream(spark, d).select("seq", F.coalesce(T.gated(F.max("confidence").over(before), F.col("confidence")), F.lit(False)).alias("gated"))


@query(f"WITH {FACT_STREAM_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY at, seq) AS n FROM facts) SELECT src, rel, dst, string_agg(DISTINCT episode_id || ':close', ',' ORDER BY episode_id || ':close') AS disputed_by FROM s WHERE n > 1 GROUP BY src, rel, dst")
def t12_dispute(spark, d):
    n = F.row_number().over(Window.partitionBy("src", "rel", "dst").orderBy("at", "seq"))
    s = fact_stream(spark, d).withColumn("n", n).withColumns({"status": F.when(F.col("n") == 1, "asserted").otherwise("ended"), "confidence": F.when(F.col("n") == 1, 0.9).otherwise(0.5)})
    f = M.merge_facts(s).where(F.size("disputed_by") > 0)
    return f.select("src", "rel", "dst", F.array_join(F.array_sort("disputed_by"), ",").alias("disputed_by"))


@query(f"WITH {_SCD2}, e AS (SELECT src, rel, dst, min(at) AS at FROM facts WHERE seq % 13 = 0 GROUP BY ALL) SELECT w.seq, CASE WHEN w.invalid_at = '' AND e.at IS NOT NULL THEN e.at ELSE w.invalid_at END AS invalid_at, w.invalid_at = '' AND e.at IS NOT NULL AS closed FROM w LEFT JOIN e USING (src, rel, dst)")
def t03_close(spark, d):
    ends = fact_stream(spark, d).where("seq % 13 = 0").select("src", "rel", "dst", "at", "episode_id")
    f = T.supersede(fact_stream(spark, d)).withColumn("belief", F.lit("asserted"))
    return T.close(f, ends).select("seq", "invalid_at", F.col("closed_by").isNotNull().alias("closed"))


@query(f"WITH {_SCD2} SELECT src, rel, dst, seq, CASE WHEN seq % 4 = 0 THEN valid_at[1:10] ELSE valid_at END AS valid_at FROM w")
def t21_rekey(spark, d):
    f = T.supersede(fact_stream(spark, d)).select("src", "rel", "dst", "seq", "valid_at")
    return T.rekey(f, f.where("seq % 4 = 0").withColumn("new_valid_at", F.substring("valid_at", 1, 10)))


@query(f"WITH {FACT_STREAM_SQL} SELECT seq, confidence AS weight, at AS created_at, 'asserted' AS belief, '' AS invalid_at FROM facts")
def t24_new_fact(spark, d):
    return fact_stream(spark, d).withColumns(T.new_fact(F.col("at"))).select("seq", "weight", "created_at", "belief", "invalid_at")


@query(f"WITH {FACT_STREAM_SQL} SELECT src, rel, dst, min(at) AS valid_at, max(confidence) AS confidence, count(DISTINCT episode_id) AS n_episodes FROM facts GROUP BY ALL")
def t07_confirm(spark, d):
    return T.confirm(fact_stream(spark, d))


@query(f"WITH {FACT_STREAM_SQL} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, seq FROM facts WHERE src <> dst")
def t14_symmetric_pin(spark, d):
    return G.pin(fact_stream(spark, d).select("src", "dst", "seq"))


@query(f"WITH {_SCD2} SELECT seq, src || ' --' || rel || '--> ' || dst || CASE WHEN valid_at <> '' AND invalid_at <> '' THEN ' (since ' || valid_at[1:10] || '; until ' || invalid_at[1:10] || '; ended)' WHEN valid_at <> '' THEN ' (mentioned ' || valid_at[1:10] || ')' ELSE '' END || ' [' || episode_id || ']' AS line FROM w")
def t15_fact_line(spark, d):
    return T.supersede(fact_stream(spark, d)).select("seq", T.fact_line().alias("line"))


@query(f"WITH {_SCD2} SELECT seq, src, rel, dst, nullif(valid_at, '') AS valid_at, nullif(invalid_at, '') AS invalid_at, CASE WHEN invalid_at = '' THEN 'active' ELSE 'closed' END AS status FROM w")
def t16_fact_rows(spark, d):
    w = T.supersede(fact_stream(spark, d))
    return w.select("seq", "src", "rel", "dst", F.nullif("valid_at", F.lit("")).alias("valid_at"), F.nullif("invalid_at", F.lit("")).alias("invalid_at"), F.when(F.col("invalid_at") == "", "active").otherwise("closed").alias("status"))


@query(f"WITH {FACT_STREAM_SQL}, e AS (SELECT 'user_' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING') SELECT DISTINCT episode_id FROM facts WHERE src IN (SELECT id FROM e) OR dst IN (SELECT id FROM e)")
def t17_fact_episodes(spark, d):
    e = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("user_"), "c_custkey").alias("id"))
    f = fact_stream(spark, d)
    return f.join(e, f["src"] == e["id"], "left_semi").select("episode_id").unionByName(f.join(e, f["dst"] == e["id"], "left_semi").select("episode_id")).distinct()


@query(f"WITH {_SCD2}, o AS (SELECT DISTINCT src, rel, dst, valid_at, invalid_at FROM w WHERE src = 'user_7') SELECT * FROM o ORDER BY valid_at, src, rel, dst, invalid_at LIMIT 40")
def t18_history(spark, d):
    return T.history(T.supersede(fact_stream(spark, d)).where("src = 'user_7'").select("src", "rel", "dst", "valid_at", "invalid_at"))


# ---- graph

_EDGES = FACT_STREAM_SQL + ", edges AS (SELECT src, dst, rel AS etype, confidence, 1.0::DOUBLE AS weight, seq FROM facts)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return fact_stream(spark, d).select("src", "dst", F.col("rel").alias("etype"), "confidence", F.lit(1.0).alias("weight"), "seq")


@query(f"WITH {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, etype ORDER BY confidence * weight DESC, seq DESC) AS n FROM edges) SELECT src, dst, etype, seq, confidence FROM r WHERE n = 1")
def g03_strongest_edge(spark, d):
    return G.strongest(_edges(spark, d), ["src", "dst", "etype"]).select("src", "dst", "etype", "seq", "confidence")


@query(f"WITH {_EDGES}, b AS (SELECT src AS a, dst AS b, etype FROM edges UNION ALL SELECT dst, src, etype FROM edges) SELECT b AS neighbour, etype, count(*) AS n FROM b WHERE a = 'k_1' GROUP BY ALL")
def g05_neighbours(spark, d):
    return G.both_ways(_edges(spark, d)).where("src = 'k_1'").groupBy(F.col("dst").alias("neighbour"), "etype").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n.n_name AS entity, o.o_orderkey AS episode FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey")
def g09_mention_star(spark, d):
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("entity"), F.col("o_orderkey").alias("episode")).distinct()


@query(f"WITH {_SCD2} SELECT rel, count(*) AS facts, count(*) FILTER (invalid_at = '') AS open, count(*) FILTER (invalid_at <> '') AS closed FROM w GROUP BY rel")
def g10_store_stats(spark, d):
    w = T.supersede(fact_stream(spark, d))
    return w.groupBy("rel").agg(F.count("*").alias("facts"), F.count_if(F.col("invalid_at") == "").alias("open"), F.count_if(F.col("invalid_at") != "").alias("closed"))


@query("SELECT doc_id, sha256('text' || text || lang || doc_id) AS content_hash FROM documents")
def g14_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("text"), "text", "lang", F.col("doc_id").cast("string")), 256).alias("content_hash"))


@query("WITH r AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents), known AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'src1') SELECT doc_id FROM r WHERE n = 1 AND h NOT IN (SELECT h FROM known)")
def g15_new_items(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return first.join(docs.where("source = 'src1'").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS version FROM documents")
def g16_versions(spark, d):
    order = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", "source", (F.row_number().over(order) - 1).cast("long").alias("version"))


@query(f"""WITH {FACT_STREAM_SQL}, m AS (SELECT src AS member, dst || '/' || rel AS hub, max(at) AS at FROM facts GROUP BY ALL), n AS (SELECT count(DISTINCT member) AS n FROM m),
 i AS (SELECT hub, ln(1 + any_value(n) / count(DISTINCT member)) AS idf FROM m, n GROUP BY hub), l AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY at DESC, member DESC) AS r FROM m),
 p AS (SELECT a.member AS src, b.member AS dst, count(*) AS n_hubs, sum(idf) AS w FROM l a JOIN l b ON a.hub = b.hub AND a.member < b.member AND a.r <= 256 AND b.r <= 256 JOIN i ON i.hub = a.hub GROUP BY ALL)
 SELECT src, dst, n_hubs, round(least(1.0, w / 3), 3) AS confidence, round(w, 3) AS weight FROM p""")
def d01_shared_hubs(spark, d):
    m = fact_stream(spark, d).select(F.col("src").alias("member"), F.concat("dst", F.lit("/"), "rel").alias("hub"), "at")
    return G.shared_hubs(m)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s WHERE score >= 0.3) SELECT src, dst, score, rank FROM r WHERE rank <= 7""")
def d04_nearest(spark, d):
    return G.nearest_all(vectors(spark, d), 7, 0.3)


@query("SELECT vec_id AS node_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def v01_norm(spark, d):
    return vectors(spark, d).select("node_id", F.round(K.norm(F.col("vec")), 6).alias("norm"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT b.vec_id AS node_id, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id = 3 AND b.vec_id NOT IN (3, 4)) SELECT * FROM s ORDER BY score DESC, node_id LIMIT 10")
def v02_top_cosine(spark, d):
    v = vectors(spark, d)
    return G.nearest(v.where("node_id = 3"), v.where("node_id not in (3, 4)"), 10, -1.0).select(F.col("dst").alias("node_id"), "score")


_PROJECTION = _EDGES + """, bt AS (SELECT src, dst, etype, max(greatest(1e-4, confidence * weight)) AS w FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, etype, confidence, weight FROM edges WHERE src <> dst) GROUP BY ALL),
 proj AS (SELECT src, dst, sum(w) AS w FROM bt GROUP BY ALL), bw AS (SELECT src, dst, w FROM proj UNION ALL SELECT dst, src, w FROM proj), deg AS (SELECT src, sum(w) AS d FROM bw GROUP BY src), step AS (SELECT bw.src, bw.dst, w / d AS p FROM bw JOIN deg USING (src))"""


@query(f"WITH {_PROJECTION} SELECT src, dst, round(w, 6) AS w FROM proj")
def p01_projection(spark, d):
    return G.projection(_edges(spark, d)).select("src", "dst", F.round("w", 6).alias("w"))


@query(f"WITH {_PROJECTION} SELECT src AS id, round(d, 6) AS degree FROM deg")
def p05_degrees(spark, d):
    return G.both_ways(G.projection(_edges(spark, d))).groupBy(F.col("src").alias("id")).agg(F.round(F.sum("w"), 6).alias("degree"))


@query(f"WITH {_PROJECTION} SELECT src, dst, round(p, 6) AS p FROM step")
def p09_transition(spark, d):
    return G.transition(G.projection(_edges(spark, d))).select("src", "dst", F.round("p", 6).alias("p"))


_RANK = ", r0 AS (SELECT 'user_7' AS id, 1.0::DOUBLE AS r)" + "".join(
    f", r{i} AS (SELECT coalesce(m.id, s.id) AS id, 0.5 * coalesce(m.m, 0.0) + 0.5 * coalesce(s.r, 0.0) AS r FROM (SELECT dst AS id, sum(r * p) AS m FROM r{i - 1} JOIN step ON src = r{i - 1}.id GROUP BY dst) m FULL JOIN r0 s ON m.id = s.id)" for i in (1, 2, 3)
)


@query(f"WITH {_PROJECTION}{_RANK} SELECT id, round(r, 6) AS score FROM r3")
def p06_personalized_rank(spark, d):
    seeds = spark.createDataFrame([("user_7", 1.0)], "id string, mass double")
    return G.personalized_rank(G.projection(_edges(spark, d)), seeds, 0.5, 3).select("id", F.round("r", 6).alias("score"))


@query()
def p06_personalized_rank_full(spark, d):
    seeds = spark.createDataFrame([("user_7", 1.0)], "id string, mass double")
    return G.settled_rank(G.projection(_edges(spark, d)), seeds, 0.5).select("id", F.round("r", 6).alias("score"))


@query(f"WITH {_PROJECTION}, h1 AS (SELECT DISTINCT dst AS id FROM bw WHERE src = 'user_7'), h2 AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM h1)), h3 AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM h2)), h4 AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM h3)), h5 AS (SELECT DISTINCT dst AS id FROM bw WHERE src IN (SELECT id FROM h4)) SELECT id, min(hop)::INT AS hop FROM (SELECT 'user_7' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3 UNION ALL SELECT id, 4 FROM h4 UNION ALL SELECT id, 5 FROM h5) GROUP BY id")
def p10_hops(spark, d):
    starts = spark.createDataFrame([("user_7",)], "id string")
    return G.hops(G.projection(_edges(spark, d)), starts)


@query()
def p13_communities(spark, d):
    return G.settled_labels(G.projection(_edges(spark, d)))


# ---- lexical search, ranking, metrics

_BM25 = """w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), tf AS (SELECT id, t, count(*) AS tf FROM w GROUP BY ALL), sz AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents),
 al AS (SELECT count(*) AS docs, avg(n) AS mean FROM sz), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
 sc AS (SELECT query_id, id, round(sum(greatest(0.0, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN df USING (t) JOIN tf USING (t) JOIN sz USING (id), al GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0), top AS (SELECT * FROM rk WHERE rank <= 10)"""


def _search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.bm25(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens FROM documents")
def l02_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(K.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {_BM25} SELECT query_id, id, score, rank FROM top")
def l03_bm25(spark, d):
    return _search(spark, d).select("query_id", "id", "score", "rank")


@query(f"WITH {_BM25}, o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM top), u AS (SELECT query_id, id, rank FROM top UNION ALL SELECT query_id, id, rank FROM o) SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score, count(*) AS n_sources FROM u GROUP BY ALL")
def l06_fusion(spark, d):
    # both ranks from one search
    top = _search(spark, d).withColumn("by_id", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return R.fuse(top.select("query_id", "id", F.explode(F.array("rank", "by_id")).alias("rank")))


@query(f"WITH {_BM25}, g AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT query_id, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall, round(coalesce(1 / min(rank), 0.0), 6) AS mrr FROM g LEFT JOIN top USING (query_id, id) GROUP BY query_id")
def e01_recall_mrr(spark, d):
    docs, items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    gold = R.containing(docs, items)
    return R.retrieval_metrics(_search(spark, d), gold, 5)


@query("SELECT lang, quality, count(*) AS n, sum(toxic)::BIGINT AS toxic, round(avg(toxic), 6) AS share FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, quality)")
def e13_totals(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.rollup("lang", "quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.round(F.avg("toxic"), 6).alias("share"))


def _lane_sql() -> str:
    rules = []
    for name, _, sets in R.LANE_CUES:
        parts = ["(" + " OR ".join(f"contains(q, ' {p} ')" for p in phrases) + ")" for phrases in sets]
        rules.append(f"WHEN {' AND '.join(parts)} THEN '{name}'")
    return f"CASE {' '.join(rules)} ELSE 'single' END"


@query(f"WITH q AS (SELECT conv_id, turn, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g') || ' ' AS q FROM conversations) SELECT conv_id, turn, {_lane_sql()} AS lane FROM q")
def r07_lane(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.lane(F.col("text")).alias("lane"))


@query(f"WITH {FACT_STREAM_SQL} SELECT episode_id, at FROM facts WHERE at[1:10] BETWEEN '2024-01-05' AND '2024-01-07'")
def r11_date_range(spark, d):
    return fact_stream(spark, d).where(F.substring("at", 1, 10).between("2024-01-05", "2024-01-07")).select("episode_id", "at")


@query(f"WITH {FACT_STREAM_SQL} SELECT episode_id, at FROM facts ORDER BY at DESC, seq LIMIT 16")
def r12_recent(spark, d):
    return fact_stream(spark, d).orderBy(F.desc("at"), "seq").limit(16).select("episode_id", "at")


@query(f"WITH {_BM25}, b AS (SELECT top.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM top JOIN documents ON doc_id = id), p AS (SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM b WHERE n <= 2) SELECT * FROM p WHERE place <= 5")
def b01_context(spark, d):
    ranked = _search(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return R.first_of_each(ranked, "source", 2, 5).select("query_id", "id", "source", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))[1:512] AS snippet FROM documents")
def r17_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.trim(F.regexp_replace("text", "[ \\t\\n]+", " ")), 1, 512).alias("snippet"))


# ---- sources


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 14400000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM e)
 SELECT user_id, session, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM s GROUP BY user_id, session""")
def s22_sessions(spark, d):
    return R.sessions(table(spark, d, "events").select("user_id", "event_id", "ts"), 4 * 3600)


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def s24_chat_sessions(spark, d):
    return chat_sessions(spark, d)


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS domain, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def s50_page_links(spark, d):
    return page_links(spark, d)


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def g_next_turns(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(order).alias("previous"))


@query("SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS n_sentences FROM documents")
def x_sentence_counts(spark, d):
    marked = F.regexp_replace("text", "([.!?])\\s+", "$1\x01")
    return table(spark, d, "documents").select("doc_id", F.size(F.split(marked, "\x01")).cast("long").alias("n_sentences"))


@query("SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c, LATERAL (SELECT * FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) o")
def q08_top_for_each(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(spark, d, "orders").withColumn("_n", F.row_number().over(order)).where("_n <= 3")
    c = table(spark, d, "customer").select("c_custkey")
    return top.join(c, top["o_custkey"] == c["c_custkey"]).select("c_custkey", "o_orderkey", "o_totalprice")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as they stood at a date."""
    return t01_active_as_of(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
