"""Queries on stored vectors, node payloads, note dates and broad questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import keys as K
from chronoloom.functions import notes as N
from chronoloom.operators import ranking as R
from chronoloom.operators import vectors as V
from chronoloom.plans.registry import query
from chronoloom.sources import episode_graph as EG
from chronoloom.sources.episode_graph import GRAPH_SQL
from chronoloom.sources.tables import table, vectors

_STORED = "WITH r AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), v AS (SELECT node_id, CASE WHEN n > 0 THEN list_transform(e, lambda x: x / n) ELSE e END AS vec FROM r)"


def _stored(spark, d):
    return vectors(spark, d).select("node_id", V.unit(F.col("vec")).alias("vec"))


@query(f"""{_STORED}, s AS (SELECT node_id, vec FROM v WHERE node_id % 10 <> 0 UNION ALL SELECT node_id, list_reverse(vec) FROM v WHERE node_id % 10 = 0 UNION ALL SELECT -1 - node_id, vec FROM v WHERE node_id % 10 = 1)
 SELECT node_id, round(vec[1], 6) AS first_part, round(sqrt(list_dot_product(vec, vec)), 6) AS norm FROM s""")
def v03_put_vectors(spark, d):
    raw = vectors(spark, d)
    changed = raw.where("node_id % 10 = 0").select("node_id", F.reverse("vec").alias("vec"))
    added = raw.where("node_id % 10 = 1").select((-1 - F.col("node_id")).alias("node_id"), "vec")
    s = V.put_vectors(_stored(spark, d), changed.unionByName(added))
    return s.select("node_id", F.round(F.col("vec")[0], 6).alias("first_part"), F.round(K.norm(F.col("vec")), 6).alias("norm"))


@query(f"{_STORED} SELECT node_id, round(vec[1], 6) AS first_part FROM v WHERE node_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def v04_remove_vectors(spark, d):
    gone = vectors(spark, d).where("label = 1").select("node_id")
    return V.remove_vectors(_stored(spark, d), gone).select("node_id", F.round(F.col("vec")[0], 6).alias("first_part"))


@query(f"WITH {GRAPH_SQL} SELECT id, ntype, name, valid FROM nd")
def w04_node_payload(spark, d):
    stored = V.to_payload(EG.nodes(spark, d).withColumn("written_by_a_later_version", F.lit(1)))
    return V.from_payload(stored, "ntype string, name string, valid boolean")


_NOTE_DATES = {"date": "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN '\"2024-01-0' || (doc_id % 9 + 1) || '\"' END", "created": "CASE WHEN doc_id % 3 = 0 THEN '2023-05-0' || (doc_id % 9 + 1) END", "date created": "CASE WHEN doc_id % 7 = 0 THEN '2022-07-01' END"}


@query(f"""WITH h AS (SELECT doc_id, {", ".join(f'{e} AS "{n}"' for n, e in _NOTE_DATES.items())} FROM documents) SELECT doc_id, coalesce(nullif(replace(date, '"', ''), ''), created, "date created", '2020-01-01') AS note_date FROM h""")
def s30_note_date(spark, d):
    head = table(spark, d, "documents").select("doc_id", F.create_map(*[x for n, e in _NOTE_DATES.items() for x in (F.lit(n), F.expr(e))]).alias("head"))
    return head.select("doc_id", N.note_date(lambda n: F.try_element_at("head", F.lit(n)), F.lit("2020-01-01")).alias("note_date"))


_BROAD = " OR ".join(f"contains(q, ' {c} ')" for c in R.BREADTH_CUES)


@query(f"WITH q AS (SELECT conv_id, turn, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g') || ' ' AS q FROM conversations) SELECT conv_id, turn, {_BROAD} AS broad FROM q")
def p16_breadth(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.breadth(F.col("text")).alias("broad"))
