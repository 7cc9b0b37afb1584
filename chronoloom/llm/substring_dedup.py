"""Incremental removal of repeated word windows with a log-structured fingerprint index.

The index holds one entry for each class of regions (see ``anchors``): anchor hash, content digest and the first
region with that content. A batch's classes are a sorted immutable run. To ingest a batch its run is merge-joined with
the older runs: a region whose class is known from an earlier document is repeated as a whole. Where an
anchor hash has several classes, their windows are compared one by one (128-bit hashes of the windows' words), which verifies
partial repeats. Once there are more than ``max_runs`` runs, they are compacted into one, an entry for each class.

Batches come in ascending order of doc_id, so what is in the index is earlier.

Defined results: null and empty texts have no words; a repeated row is the same document, so rows of one doc_id don't
count against each other, and have to repeat its text; a row with a null doc_id loses nothing and counts against none; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.anchors import Words, merged, region_rows, spans_of, with_texts
from chronoloom.llm.common import delete_path, materialize, mix64, shared_dir, spread_join, trimmed, window_hashes

RUN = "fp long, digest long, rep struct<doc_id:long,lo:long,hi:long>"


class FingerprintIndex:
    """Sorted runs of region classes in shared storage."""

    def __init__(self, spark: SparkSession, window: int = 50, gram: int = 8, max_runs: int = 4) -> None:
        self.spark, self.kind, self.max_runs = spark, Words(window, gram), max_runs
        self.runs: list[str] = []

    def _write(self, classes: DataFrame) -> str:
        path = shared_dir(self.spark, "run")
        classes.sortWithinPartitions("fp", "digest").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def compact(self) -> None:
        """One run instead of all; the old ones are deleted once it is written."""
        if len(self.runs) < 2:
            return
        old = self.runs
        self.runs = [self._write(self._read(old).groupBy("fp", "digest").agg(F.min("rep").alias("rep")))]
        for path in old:
            delete_path(self.spark, path)

    def ingest(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """Spans (doc_id, start, end) of words to remove from the batch; its run joins the index. ``corpus``: all texts so far."""
        kind, window = self.kind, self.kind.window
        rows = materialize(region_rows(batch, self.kind), "regions")
        new = self._write(rows.groupBy("fp", "digest").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("rep")))
        fresh = self._read([new])
        if self.runs:
            known = self._read(self.runs).join(fresh.select("fp").distinct(), "fp", "left_semi")
            classes = materialize(known.unionByName(fresh).groupBy("fp", "digest").agg(F.min("rep").alias("rep")), "classes")
        else:
            classes = fresh
        several = classes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
        placed = rows.join(classes.select("fp", "digest", F.col("rep.doc_id").alias("first")), ["fp", "digest"])
        whole = placed.where("first < doc_id").selectExpr("doc_id", "lo start", f"hi + {window} end")
        own = placed.where("first = doc_id").select("fp", "doc_id", "lo", "hi")
        if self.runs:  # what earlier batches have of these hashes
            own = own.unionByName(classes.select("fp", "rep.*")).distinct()
        # a common anchor has many classes: its rows stay where they are
        wanted = spread_join(materialize(own, "own"), several, ["fp"], "n", classes.count()).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("regions"))

        def windows(docs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for doc_id, text, regions in docs:
                h = kind.units(text)
                at = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in regions])
                at = np.unique(at[at + window <= len(h)])
                one, two = window_hashes(h, window), window_hashes(mix64(h + np.uint64(0x5851F42D4C957F2D)), window)
                for col, x in zip(cols, (one[at].view(np.int64), two[at].view(np.int64), np.full(len(at), doc_id), at), strict=True):
                    col.append(x)
                held += len(at)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["one", "two", "doc_id", "start"])
                    cols, held = [[], [], [], []], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["one", "two", "doc_id", "start"])

        single = materialize(with_texts(corpus, wanted, "inner", windows, "one long, two long, doc_id long, start long"), "windows")
        first = single.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("one", "two", "first")
        part = single.join(first, ["one", "two"]).where("first < doc_id").selectExpr("doc_id", "start", f"start + {window} end")
        spans = materialize(whole.unionByName(part), "spans")  # before compaction deletes the runs it reads
        self.runs.append(new)
        if len(self.runs) > self.max_runs:
            self.compact()
        return spans


def remove_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Cut the spans of words out of the texts."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def cut(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

        for doc_id, text, starts, ends in rows:
            words, kept, at, gone = text.split(), [], 0, 0
            for a, b in merged(starts or [], ends or []):
                kept += words[at:a]
                at = b
                gone += b - a
            kept += words[at:]
            out.append((doc_id, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            if len(out) == 2000:
                yield batch_of()
                out = []
        if out:
            yield batch_of()

    return with_texts(docs, spans_of(spans), "left", cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = 50, gram: int = 8, batches: int = 2, max_runs: int = 1) -> DataFrame:
    """Ingest the table in ``batches`` ranges of doc_id and cut what earlier documents have."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    index = FingerprintIndex(docs.sparkSession, window, gram, max_runs)
    inner = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(x) for x in inner}), None]
    spans = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        sofar = docs if high is None else docs.where(F.col("doc_id") <= high)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        found = index.ingest(part, sofar)
        spans = found if spans is None else spans.unionByName(found)
    return remove_words(docs, spans)
