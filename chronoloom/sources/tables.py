"""The driver's tables as the engine's inputs: episodes, facts, sessions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asserted fact for each event: a user relates to the value in its properties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("src"),
        F.col("event_type").alias("rel"),
        F.concat(F.lit("k_"), F.get_json_object("props", "$.k")).alias("dst"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        F.concat(F.lit("ep_"), F.col("event_id")).alias("episode_id"),
        F.round(F.coalesce(F.col("value"), F.lit(0.0)) / (1 + F.abs(F.coalesce(F.col("value"), F.lit(0.0)))), 3).alias("confidence"),
    )


FACT_STREAM_SQL = """facts AS (SELECT event_id AS seq, 'user_' || user_id AS src, event_type AS rel, 'k_' || json_extract_string(props, '$.k') AS dst,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, 'ep_' || event_id AS episode_id, round(coalesce(value, 0.0) / (1 + abs(coalesce(value, 0.0))), 3) AS confidence FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vec"))


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation, its turns rendered in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit(""))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(lines, "\n").alias("rendered"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the host of their address and their title."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1)), "^www\\.", "")
    return pages.select("page_id", host.alias("domain"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
