"""The training corpus from raw documents, stage by stage.

Each stage takes all that the one before it kept; the last gives the packed sequences.

Defined results: rows with a null or empty text fail the quality rules and go; of rows that repeat a doc_id each goes or stays by its own text,
and of rows with the same doc_id and text one stays; columns of any name are carried to the last stage; very long
texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.common import materialize, small_batches
from chronoloom.llm.jaccard import one_of_each
from chronoloom.llm.packing import pack_documents
from chronoloom.llm.quality import keep_quality
from chronoloom.llm.registry import byte_bpe
from chronoloom.llm.suffix_dedup import cut_texts
from chronoloom.llm.toxicity import drop_toxic, fit_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the base or the repetition rules reject go."""
    small_batches(spark)
    return keep_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a score of 0.5 or more go."""
    small_batches(spark)
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity of 0.8: the least doc_id of each group stays."""
    small_batches(spark)
    return one_of_each(docs, n=5, num=80, den=100)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out: a passage of over 50 words has 204 or more where words have three letters on average."""
    small_batches(spark)
    return cut_texts(docs, window=200, gram=32)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 tokens."""
    small_batches(spark)
    return pack_documents(docs, byte_bpe(), end_id=0, window=1024)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeats), ("packing", packing)]

#: Tokens and suffix arrays are beyond SQL; tests/llm compares each stage with a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
