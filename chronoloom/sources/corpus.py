"""Question corpora: JSON lines of sessions and questions, their items, evidence and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators.graph import held

EPISODES = "question_id string, session_id string, created_at string, text string, is_evidence boolean"
QUESTIONS = "question_id string, question string, answer string, kind string, created_at string"


def episodes(spark: SparkSession, path: str, question_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions of a corpus; a limit of 0 or less gives none."""
    rows = spark.read.schema(EPISODES).json(path)
    if question_id is not None:
        rows = rows.where(F.col("question_id") == question_id)
    return rows if limit is None else rows.limit(max(0, limit))


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(QUESTIONS).json(path)
    return rows if limit is None else rows.limit(max(0, limit))


def items(rows: DataFrame, tier: str) -> DataFrame:
    return rows.withColumn("source_ref", F.concat_ws("/", F.lit("corpus"), F.lit(tier), "question_id", "session_id"))


def evidence(rows: DataFrame) -> DataFrame:
    """The evidence sessions of each question, in order of time."""
    kept = rows.where("is_evidence").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "session_id"))).alias("s"))
    return kept.select("question_id", F.transform("s", lambda x: x["session_id"]).alias("sessions"))


def instances(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each question with its sessions in order of time; without any, an empty list."""
    grouped = sessions.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "session_id"))).alias("sessions"))
    joined = questions.join(grouped, "question_id", "left")
    return joined.withColumn("sessions", F.coalesce("sessions", F.filter(F.array(F.struct(F.lit(None).cast(sessions.schema["created_at"].dataType).alias("created_at"), F.lit(None).cast(sessions.schema["session_id"].dataType).alias("session_id"))), lambda x: F.lit(False))))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place from 1 in an order, in ranges of that order: no task has more than a range."""
    cut = held(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = cut.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")


def interleaved(rows: DataFrame) -> DataFrame:
    """An order of rows (kind, id) whose every beginning has the kinds in proportion."""
    ranked = _numbered(rows, ["kind", "id"], "_at")
    kinds = ranked.groupBy(F.col("kind").alias("_kind")).agg(F.count("*").alias("_n"), (F.min("_at") - 1).alias("_first"))
    each = ranked.join(F.broadcast(kinds), F.col("kind").eqNullSafe(F.col("_kind"))).withColumn("pos", F.round((F.col("_at") - F.col("_first") - F.lit(0.5)) / F.col("_n"), 9)).drop("_at", "_kind", "_n", "_first")
    return _numbered(each, ["pos", "kind", "id"], "place")


def capped(sessions: DataFrame, cap: int) -> DataFrame:
    """All evidence sessions of a question, then the earliest others up to the cap."""
    w = Window.partitionBy("question_id")
    placed = sessions.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("is_evidence"), "created_at", "id")), "_e": F.count_if("is_evidence").over(w)})
    return placed.where(F.col("_n") <= F.greatest(F.lit(cap), F.col("_e"))).drop("_n", "_e")
