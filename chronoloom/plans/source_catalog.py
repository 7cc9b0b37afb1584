"""Queries on sources: sessions, notes, pages, paths and corpus rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import notes as N
from chronoloom.functions.extraction import modality
from chronoloom.plans.extract_catalog import _pick, _picked
from chronoloom.plans.registry import query
from chronoloom.sources import chats as CH
from chronoloom.sources import corpus as CO
from chronoloom.sources import repositories as RP
from chronoloom.sources import vault as V
from chronoloom.sources.tables import table

# ---- sessions: events as messages of a user, every seventh without a time

_EV = "ev AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events), ss AS (SELECT *, sum(CASE WHEN ts IS NOT NULL AND p IS NOT NULL AND epoch_us(ts) - epoch_us(p) > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS session FROM (SELECT *, last_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ev))"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp")).alias("ts"))
    return CH.with_sessions(e, "user_id", ["event_id"], "ts")


@query(f"WITH {_EV} SELECT user_id, event_id, session FROM ss")
def s22_gap_sessions(spark, d):
    return _sessions(spark, d).select("user_id", "event_id", "session")


@query(f"WITH {_EV} SELECT user_id, session, strftime(arg_min(ts, event_id) FILTER (ts IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS start FROM ss GROUP BY ALL")
def s23_session_start(spark, d):
    return CH.session_starts(_sessions(spark, d), "user_id", "event_id", "ts").select("user_id", "session", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


_DATED = "strftime(s, '%Y/%m/%d (%a) %H:%M')"


@query(f"WITH {_EV}, g AS (SELECT user_id, session, arg_min(ts, event_id) FILTER (ts IS NOT NULL) AS s, string_agg(upper(event_type[1]) || event_type[2:] || ': v' || event_id, chr(10) ORDER BY event_id) AS lines FROM ss WHERE event_id % 5 <> 0 GROUP BY ALL) SELECT user_id, session, md5(CASE WHEN s IS NULL THEN '[chat session]' ELSE '[chat session — ' || {_DATED} || ']' END || chr(10) || lines) AS body FROM g")
def s24_rendering(spark, d):
    said = _sessions(spark, d).where("event_id % 5 <> 0").withColumns({"role": F.col("event_type"), "text": F.concat(F.lit(" v"), "event_id")})
    return CH.rendered_sessions(said, "user_id", "event_id", "ts").select("user_id", "session", F.md5("text").alias("body"))


@query(f"WITH {_EV}, s AS (SELECT DISTINCT user_id, session FROM ss), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY session) AS k FROM s) SELECT CASE WHEN n = 1 THEN user_id::VARCHAR ELSE printf('%d#s%02d', user_id, k) END AS id, 'import:' || user_id AS source_ref FROM n")
def s25_session_items(spark, d):
    return CH.session_items(_sessions(spark, d).select("user_id", "session").distinct(), "user_id").select("id", "source_ref")


@query("SELECT event_id, strftime(ts, '%Y/%m/%d (%a) %H:%M') AS shown FROM events")
def s80_header_date(spark, d):
    return table(spark, d, "events").select("event_id", N.header_date(F.col("ts")).alias("shown"))


TIMES = ["2024-01-05T10:20:30Z", "1704450030", "1704450030.5", "soon", "2024-01-05", "2024-01-05 10:20:30"]


@query("SELECT id, (['2024-01-05 10:20:30.000', '2024-01-05 10:20:30.000', '2024-01-05 10:20:30.500', NULL, '2024-01-05 00:00:00.000', '2024-01-05 10:20:30.000'])[id % 6 + 1] AS instant FROM (SELECT p_partkey AS id FROM part)")
def s27_instants(spark, d):
    return _pick(spark, d, TIMES, "t").select("id", F.date_format(N.instant(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS").alias("instant"))


@query("WITH RECURSIVE n AS (SELECT conv_id, turn AS id, CASE WHEN turn > 0 THEN turn - CASE WHEN turn % 3 = 2 AND turn > 1 THEN 2 ELSE 1 END END AS parent FROM conversations), r AS (SELECT conv_id, max(id) AS id, 0 AS up FROM n GROUP BY conv_id UNION ALL SELECT r.conv_id, n.parent, up + 1 FROM r JOIN n ON n.conv_id = r.conv_id AND n.id = r.id WHERE n.parent IS NOT NULL) SELECT conv_id, id, up FROM r")
def s13_path_to_root(spark, d):
    t = F.col("turn")
    n = table(spark, d, "conversations").select("conv_id", t.alias("id"), F.when(t > 0, t - F.when((t % 3 == 2) & (t > 1), 2).otherwise(1)).alias("parent"))
    return CH.path_to_root(n, n.groupBy("conv_id").agg(F.max("id").alias("id")))


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'assistant' WHEN 1 THEN 'user' WHEN 2 THEN 'system' WHEN 3 THEN 'user' ELSE 'assistant' END AS role FROM conversations")
def s19_roles(spark, d):
    given = F.get(F.array(*[F.lit(x) for x in ("Model", "human", "system", "someone", "assistant")]), (F.col("turn") % 5).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", CH.role_of(given).alias("role"))


# ---- notes

NOTES = ["see #work and #home/garden, not a#b or `#code`", "[[Plan#Goals|the plan]] and [[Team]] ![[pic.png]]", "go to https://a.org/x, then https://b.org). https://a.org/x", "![x](img/a.png) ![y](https://z.org/b.png) ![[C.JPG|200]]", "nothing"]


def _each(lists: list[str]) -> str:
    return f"SELECT id, ({lists!r})[id % 5 + 1] AS found FROM (SELECT p_partkey AS id FROM part)"


@query(_each(["work,home/garden", "", "", "", ""]))
def s32_inline_tags(spark, d):
    return _pick(spark, d, NOTES, "t").select("id", F.array_join(N.inline_tags(F.col("t")), ",").alias("found"))


@query(_each(["", "Plan,Team", "", "", ""]))
def s33_wikilinks(spark, d):
    return _pick(spark, d, NOTES, "t").select("id", F.array_join(N.wikilinks(F.col("t")), ",").alias("found"))


@query(_each(["", "pic.png", "", "C.JPG,img/a.png", ""]))
def s34_image_embeds(spark, d):
    return _pick(spark, d, NOTES, "t").select("id", F.array_join(N.image_embeds(F.col("t")), ",").alias("found"))


@query(_each(["", "", "https://a.org/x,https://b.org", "https://z.org/b.png", ""]))
def s63_urls(spark, d):
    return _pick(spark, d, NOTES, "t").select("id", F.array_join(N.urls(F.col("t")), ",").alias("found"))


@query("SELECT id, ([['a', 'b'], ['x', 'y', 'z'], [], ['one']])[id % 4 + 1] AS parts FROM (SELECT p_partkey AS id FROM part)")
def s31_list_field(spark, d):
    return _pick(spark, d, ["[a, '#b']", "#x y,z", "", "one"], "t").select("id", N.list_field(F.col("t")).alias("parts"))


_LINKS = "nt AS (SELECT doc_id, 'v/' || source || '/' || lang || (doc_id % 40) || '.md' AS path, 'al' || doc_id AS alias FROM documents), bn AS (SELECT lang || (doc_id % 40) AS k, min(path) AS path FROM nt JOIN documents USING (doc_id) GROUP BY 1)"


@query(f"WITH {_LINKS}, l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(lang) || (doc_id % 50) WHEN 1 THEN 'AL' || doc_id ELSE 'no/' || lang || (doc_id % 40) END AS target FROM documents) SELECT l.doc_id AS src, target, coalesce(b.path, CASE WHEN NOT contains(target, '/') THEN a.path END) AS dst FROM l LEFT JOIN bn b ON b.k = lower(string_split(target, '/')[-1]) LEFT JOIN nt a ON a.alias = lower(target)")
def s35_link_resolver(spark, d):
    docs = table(spark, d, "documents")
    at = F.concat(F.lit("v/"), "source", F.lit("/"), "lang", F.col("doc_id") % 40, F.lit(".md"))
    notes = docs.select(at.alias("path"), F.array(F.concat(F.lit("al"), "doc_id")).alias("aliases"))
    target = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.col("doc_id") % 50)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("AL"), "doc_id")).otherwise(F.concat(F.lit("no/"), "lang", F.col("doc_id") % 40))
    targets = V.link_targets(notes)
    # notes of one path are one
    return V.resolved_links(docs.select(F.col("doc_id").alias("src"), target.alias("target")), targets.dropDuplicates(["kind", "key", "path"]))


@query("SELECT doc_id, array_to_string([x FOR x, i IN l IF list_position([lower(y) FOR y IN l], lower(x)) = i], ' ') AS once FROM (SELECT doc_id, string_split(text, ' ')[1:15] AS l FROM documents WHERE text IS NOT NULL)")
def s36_case_distinct(spark, d):
    w = F.slice(F.split("text", " "), 1, 15)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(N.case_distinct(w), " ").alias("once"))


@query("SELECT doc_id, 'obs_' || left(sha1(source || '/' || doc_id || '.md'), 16) AS id FROM documents")
def s78_note_id(spark, d):
    return table(spark, d, "documents").select("doc_id", N.note_id(F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))).alias("id"))


@query("SELECT lower(source || '.png') AS name, min('a/' || lang || '/' || source || '.PNG') AS path FROM documents GROUP BY 1")
def s75_asset_index(spark, d):
    return V.asset_index(table(spark, d, "documents").select(F.concat(F.lit("a/"), "lang", F.lit("/"), "source", F.lit(".PNG")).alias("path")))


# ---- pages

_STRIP = "trim(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))"
_SEEN = "regexp_replace(" + "".join("regexp_replace(" for _ in range(6)) + "html" + "".join(f", '(?is)<{t}[^>]*>.*?</{t}\\s*>', ' ', 'g')" for t in ("head", "style", "script", "noscript", "template", "svg")) + ", '(?s)<!--.*?-->', ' ', 'g')"


@query(f"SELECT page_id, md5({_STRIP.format('html')}) AS text FROM pages")
def s53_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(N.stripped(F.col("html"))).alias("text"))


@query(f"SELECT page_id, md5(trim(regexp_replace({_STRIP.format(_SEEN)}, '\\s+', ' ', 'g'))) AS text FROM pages")
def s52_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(N.visible_text(F.col("html"))).alias("text"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"
_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"


@query(f"SELECT page_id, CASE WHEN page_id % 3 <> 0 AND {_TITLE} <> '' THEN {_TITLE} WHEN trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) <> '' AND page_id % 3 = 1 THEN trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) ELSE 'A web page ' || 'at ' || {_HOST} || '.' END AS description FROM pages")
def s54_page_description(spark, d):
    title = F.when(F.col("page_id") % 3 != 0, F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    h1 = F.when(F.col("page_id") % 3 == 1, F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)))
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1)), "^www\\.", "")
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.nullif(h1, F.lit("")), F.concat(F.lit("A web page at "), host, F.lit("."))).alias("description"))


@query(f"SELECT page_id, nullif({_TITLE.replace('html', 'left(html, 65536)')}, '') AS title FROM pages")
def s55_link_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract(F.substring("html", 1, 65536), "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 40 AND l_discount > 0.02 THEN 'scanned' WHEN l_discount >= 0.04 AND l_quantity >= 40 THEN 'mixed' WHEN l_linenumber <= 12 THEN 'slide' ELSE 'text' END AS kind FROM lineitem")
def s57_page_kind(spark, d):
    kind = N.page_kind(F.col("l_quantity"), F.col("l_linenumber"), F.when(F.col("l_quantity") < 40, F.col("l_discount") * 10).otherwise(F.col("l_discount")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"))


PATHS = ["src/a.py", "node_modules/x.js", "web/app.min.js", "lib/Main.JAVA", "README.md", "package-lock.json", "img/p.PNG", "doc/x.pdf", "cmd/main.go"]


@query(f"SELECT id, id % {len(PATHS)} IN (0, 3, 8) AS source FROM (SELECT p_partkey AS id FROM part)")
def s42_source_path(spark, d):
    return _pick(spark, d, PATHS, "path").select("id", N.is_source_path(F.col("path")).alias("source"))


@query(f"SELECT id, CASE id % {len(PATHS)} WHEN 6 THEN 'image' WHEN 7 THEN 'pdf' ELSE 'file' END AS modality FROM (SELECT p_partkey AS id FROM part)")
def s65_modality(spark, d):
    return _pick(spark, d, PATHS, "path").select("id", modality(F.col("path")).alias("modality"))


@query("SELECT id, (['image/png', 'image/jpeg', 'image/gif', NULL])[id % 4 + 1] AS mime FROM (SELECT p_partkey AS id FROM part)")
def s64_image_type(spark, d):
    p = _pick(spark, d, ["89504e470d0a1a0a", "ffd8ffe000", "", "00ff"], "h")
    return p.select("id", N.image_type(F.when(F.col("id") % 4 == 2, "x.GIF").otherwise("x"), F.unhex("h")).alias("mime"))


_TREE = "tr AS (SELECT DISTINCT lang || '/' || source || '/f' || (doc_id % 30) || '.py' AS path FROM documents)"


@query(f"WITH {_TREE}, f AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, string_split(path, '/')[-1] AS name FROM tr), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM f) SELECT folder, count(*) AS n, string_agg(name, ', ' ORDER BY name) FILTER (k <= 6) AS first FROM r GROUP BY folder ORDER BY folder LIMIT 60")
def s73_tree_sketch(spark, d):
    files = table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/f"), F.col("doc_id") % 30, F.lit(".py")).alias("path")).distinct()
    return RP.tree_sketch(files)


_FILES = "lv AS (SELECT doc_id % 3 AS ref, 'f' || (doc_id % 40) AS path, 'old' || doc_id AS id FROM documents), nw AS (SELECT DISTINCT ref, path, CASE WHEN id LIKE '%5' THEN id ELSE 'new_' || path END AS id FROM lv WHERE path < 'f2')"


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    live = table(spark, d, "documents").select((F.col("doc_id") % 3).alias("ref"), F.concat(F.lit("f"), F.col("doc_id") % 40).alias("path"), F.concat(F.lit("old"), "doc_id").alias("id"))
    new = live.where("path < 'f2'").select("ref", "path", F.when(F.col("id").like("%5"), F.col("id")).otherwise(F.concat(F.lit("new_"), "path")).alias("id")).distinct()
    return live, new


@query(f"WITH {_FILES}, p AS (SELECT ref, path, min(id) AS by FROM nw GROUP BY ALL) SELECT lv.id, lv.id IN (SELECT id FROM nw) OR p.by IS NULL AS valid, CASE WHEN lv.id NOT IN (SELECT id FROM nw) THEN p.by END AS superseded_by FROM lv LEFT JOIN p USING (ref, path)")
def s48_supersede_files(spark, d):
    return RP.superseded(*_files(spark, d))


@query(f"WITH {_FILES} SELECT id FROM lv WHERE path LIKE 'f1%' AND path NOT IN ('f1', 'f11', 'f13')")
def s49_reconcile(spark, d):
    live, _ = _files(spark, d)
    return RP.vanished(live, spark.createDataFrame([("f1",), ("f11",), ("f13",), ("f2",)], "path string"), "f1")


@query(f"WITH {_FILES} SELECT id FROM lv WHERE path = 'f7'")
def s72_live_files(spark, d):
    return _files(spark, d)[0].where("path = 'f7'").select("id")


# ---- corpus rows


@query("SELECT conv_id, turn, 'corpus/sample/q' || conv_id || '/s' || turn AS source_ref FROM conversations")
def s05_items(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("q"), "conv_id").alias("question_id"), F.concat(F.lit("s"), "turn").alias("session_id"))
    return CO.items(rows, "sample").select("conv_id", "turn", "source_ref")


@query("SELECT 'q' || conv_id AS question_id, string_agg('s' || turn, ',' ORDER BY 10 - turn) AS sessions FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id")
def s07_evidence(spark, d):
    rows = table(spark, d, "conversations").select(F.concat(F.lit("q"), "conv_id").alias("question_id"), F.concat(F.lit("s"), "turn").alias("session_id"), (F.col("turn") % 2 == 0).alias("is_evidence"), (10 - F.col("turn")).alias("created_at"))
    return CO.evidence(rows).select("question_id", F.array_join("sessions", ",").alias("sessions"))


@query("SELECT c_custkey AS question_id, coalesce(n, 0) AS n_sessions FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def s08_instances(spark, d):
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"))
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("created_at"))
    return CO.instances(q, s).select("question_id", F.size("sessions").cast("long").alias("n_sessions"))


@query("WITH p AS (SELECT o_orderpriority AS kind, o_orderkey AS id, (row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY o_orderpriority) AS pos FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)) SELECT id, kind, row_number() OVER (ORDER BY round(pos, 9), kind, id) AS place FROM p")
def s69_interleave(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"))
    return CO.interleaved(o).select("id", "kind", "place")


@query("WITH r AS (SELECT o_custkey AS question_id, o_orderkey AS id, o_orderstatus = 'F' AS ev, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate, o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS e FROM orders) SELECT question_id, id FROM r WHERE n <= greatest(4, e)")
def s70_session_cap(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_evidence"), F.col("o_orderdate").alias("created_at"))
    return CO.capped(o, 4).select("question_id", "id")
