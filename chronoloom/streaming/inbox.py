"""The inbox: notes as JSON files that a stream takes in once each, a ledger of all of them, and receipts."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NOTE = "id string, text string, created_at string, media array<string>, replaces string"


def spool(folder: str, text: str, created_at: str | None = None, media: list[str] | None = None, replaces: str | None = None) -> str:
    """Put a note into a local inbox folder: written beside it, then renamed, so that no half of it is ever read."""
    now = datetime.now(UTC)
    note_id = f"{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    os.makedirs(folder, exist_ok=True)
    half = os.path.join(folder, f".{note_id}.tmp")
    with open(half, "w", encoding="utf-8") as f:
        json.dump({"id": note_id, "text": text, "created_at": created_at or now.isoformat(), "media": media or [], "replaces": replaces}, f)
        f.flush()
        os.fsync(f.fileno())
    os.rename(half, os.path.join(folder, f"{note_id}.json"))
    return note_id


def pending(spark: SparkSession, folder: str, ledger: str) -> DataFrame:
    """Notes in the inbox that the ledger doesn't have, by the time they were written and name."""
    notes = spark.read.schema(NOTE).option("pathGlobFilter", "*.json").json(folder)
    return notes.join(known(spark, ledger), "id", "left_anti").orderBy("created_at", "id")


def known(spark: SparkSession, ledger: str) -> DataFrame:
    """Ids in the ledger; none where it isn't written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "id string")
    return spark.read.schema(NOTE).json(ledger).select("id").distinct()


def contained(notes: DataFrame) -> DataFrame:
    """Notes without attachments that point out of their folder."""
    safe = F.filter("media", lambda m: ~(m.startswith("/") | m.rlike(r"(^|/)\.\.(/|$)")))
    return notes.withColumn("media", safe)


def take_in(spark: SparkSession, folder: str, ledger: str, checkpoint: str, ingest: Callable[[DataFrame], None]) -> StreamingQuery:
    """A stream over the inbox: each batch without what the ledger has goes to ``ingest`` and then to the ledger, which is the receipt. A batch that fails comes again."""

    def batch(df: DataFrame, _: int) -> None:
        new = contained(df.dropDuplicates(["id"]).join(known(spark, ledger), "id", "left_anti")).persist()
        try:
            if not new.isEmpty():
                ingest(new)
                new.write.mode("append").json(ledger)
        finally:
            new.unpersist()

    source = spark.readStream.schema(NOTE).option("pathGlobFilter", "*.json").json(folder)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(spark: SparkSession, folder: str, ledger: str, last: int = 20) -> tuple[int, DataFrame]:
    """How many notes wait, and the newest receipts."""
    done = spark.read.schema(NOTE).json(ledger) if not known(spark, ledger).isEmpty() else spark.createDataFrame([], NOTE)
    return pending(spark, folder, ledger).count(), done.orderBy(F.desc("created_at"), "id").limit(last)
