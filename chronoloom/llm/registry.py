"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.common import small_batches
from chronoloom.llm.oracle import OP2, OP5, OP8, OP9


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.quality import repetition_quality

    return repetition_quality(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.sstable import token_shards

    return token_shards(table(spark, sf_dir, "documents"), word_bpe(), end_id=2)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.bpe import bpe_round

    return bpe_round(table(spark, sf_dir, "documents"), word_bpe())


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.lattice import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), byte_bpe(), end_id=0, window=1024)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), window=400).drop("starts", "ends")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), window=50)


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.stupid_backoff import backoff_scores

    return backoff_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_token_shards, op4_bpe, op5_jaccard, op6_lattice, op7_packing, op8_suffix_dedup, op9_substring_dedup, op10_stupid_backoff)}
SQL: dict[str, str] = {"op2_quality": OP2, "op5_jaccard": OP5, "op8_suffix_dedup": OP8, "op9_substring_dedup": OP9}
