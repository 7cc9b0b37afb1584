"""Stupid-backoff scores of documents, with counts from all other documents.

The n-gram tables (orders 1 to 3) are partitioned by n-gram hash, into as many ranges as keep each at some millions of n-grams. Tasks
explode their documents' n-grams into chunks; for each chunk, order and hash range one packed row holds the distinct n-grams and
their counts. Each hash range adds up the counts of all chunks, one order at a time, and answers each chunk with the totals of its
n-grams; a chunk joined with its answers gives the scores, summed per document.

Chunks are made anew from the documents for the join instead of being stored or sent twice; each carries a checksum, and a
chunk that doesn't equal the one that asked raises.

A document's own occurrences are taken off all counts, so that a text doesn't vouch for itself. The score of a word is
count(trigram) / count(its first two words), or, if that count is 0, 0.4 times the score by the bigram, likewise
the unigram count / words, where a word that no other document has counts as half a one. Words at the beginning start
at the bigram or the unigram. The document's score is the mean log10 over its words.

Words are ``[^\\x20\\x09-\\x0D]+``. N-grams are told apart by ``key_bits`` bits of a 64-bit hash (all by default: of N
n-grams about N^2 / 2^65 pairs are merged, 0.25 of 3 billion; with 48 bits it is N^2 / 2^49).

Defined results: texts without words (null, empty) have a null score and 0 words; rows are scored one by one, and a
repeated row is another document; null doc_ids keep a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import runs, shuffle_width, texts_of, trimmed, window_hashes

ORDERS = 3
CHUNK = "chunk long, doc_ids array<long>, payload binary"
SCHEMA = "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, n_unseen long, score double"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed byte string, each with its length and width before it, in byte planes: like bytes together pack better."""
    out = b"".join(np.array([len(a), a.itemsize], "<i8").tobytes() + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(out)


def _unsqueeze(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = (int(x) for x in np.frombuffer(raw, "<i8", 2, at))
        planes = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 16 + n * width
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


class Grams:
    """The n-grams of a chunk: for each place (or -1) which distinct key, and, where asked for, the keys in order."""

    def __init__(self, sizes: np.ndarray, vocabulary: np.ndarray, sequence: np.ndarray, key_bits: int, with_keys: bool = True) -> None:
        h = vocabulary[sequence]
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.keys: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        for n in range(1, ORDERS + 1):
            g = window_hashes(h, n) >> np.uint64(64 - key_bits)
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1] if len(h) >= n else np.empty(0, bool)
            keys, which = np.unique(g[inside], return_inverse=True)
            index = np.full(len(h), -1, np.int32)
            index[n - 1 :][inside] = which  # an n-gram belongs to its last word
            self.index.append(index)
            if with_keys:
                self.keys.append(keys)


def _score_block(sizes: np.ndarray, index: list[np.ndarray], totals: list[np.ndarray], words: int, alpha: float) -> list[np.ndarray]:
    """Per document of a run of whole documents: words scored by trigram, bigram and unigram, and the sum of log10 scores."""
    size = len(sizes)
    doc = np.repeat(np.arange(size), sizes)
    left = []  # for each order and place: occurrences in other documents
    for where, sums in zip(index, totals, strict=True):
        at = np.flatnonzero(where >= 0)
        _, which, own = np.unique(doc[at] * max(1, len(sums)) + where[at], return_inverse=True, return_counts=True)
        other = np.zeros(len(where), np.int64)
        other[at] = sums[where[at]].astype(np.int64) - own[which]
        left.append(other)
    one, two, three = left
    before = lambda x: np.concatenate((np.zeros(1, x.dtype), x[:-1]))[: len(x)]
    others = np.maximum(1, words - sizes)[doc]
    low = np.where(two > 0, two / np.maximum(before(one), 1), np.where(index[1] >= 0, alpha, 1.0) * np.maximum(one, 0.5) / others)
    value = np.log10(np.where(three > 0, three / np.maximum(before(two), 1), np.where(index[2] >= 0, alpha, 1.0) * low))
    by = (three > 0, (three <= 0) & (two > 0), (three <= 0) & (two <= 0) & (one > 0))
    return [*(np.bincount(doc[x], minlength=size) for x in by), np.bincount(doc, value, size)]


def backoff_scores(docs: DataFrame, chunk_words: int = 1 << 21, key_bits: int = 64, alpha: float = 0.4, block_words: int = 1 << 18, range_grams: int = 1 << 23) -> DataFrame:
    """doc_id, n_words, how many words each order scored, and the mean log10 score.

    Whole documents of about ``block_words`` words are scored at a time; a hash range has about ``range_grams`` n-grams of all orders.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.split()) for batch in batches for t in texts_of(batch))], pa.int64())], names=["words"])

    words = texts.select("text").mapInArrow(trimmed(count_words), "words long").agg(F.sum("words")).first()[0] or 0
    width = max(shuffle_width(docs.sparkSession), -(-ORDERS * words // range_grams))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list[int] = []
        known: dict[bytes, int] = {}
        sequence: list[int] = []

        def flush() -> pa.RecordBatch:
            vocabulary = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            payload = _squeeze(_narrow(np.array(sizes, np.int64)), vocabulary, _narrow(np.array(sequence, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["chunk", "doc_ids", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                words = text.split()
                ids.append(doc_id)
                sizes.append(len(words))
                sequence += [known.setdefault(w, len(known)) for w in words]
                if len(sequence) >= chunk_words or len(ids) >= 1 << 14:
                    yield flush()
                    number += 1
                    ids, sizes, known, sequence = [], [], {}, []
        if ids:
            yield flush()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "order", "chunk", "sum", "payload"]
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                check = zlib.crc32(payload)
                grams = Grams(*_unsqueeze(payload), key_bits)
                rows: list[tuple] = []
                for n, (keys, index) in enumerate(zip(grams.keys, grams.index, strict=True), 1):
                    count = np.bincount(index[index >= 0], minlength=len(keys))
                    cut = np.searchsorted(keys, np.array([(i << key_bits) // width for i in range(width + 1)], np.uint64) if key_bits < 64 else _even_cuts(width))
                    cut[-1] = len(keys)
                    for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                        if a < b:
                            steps = np.diff(keys[a:b], prepend=np.uint64(0))
                            rows.append((p, n, chunk, check, _squeeze(steps[:1], _narrow(steps[1:]), _narrow(count[a:b]))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (p, n), group in groupby(stream, key=lambda r: r[:2]):  # one hash range and order at a time
            rows, keys, counts = [], [], []
            for _, _, chunk, check, payload in group:
                head, steps, count = _unsqueeze(payload)
                rows.append((chunk, check))
                keys.append(np.cumsum(np.concatenate((head, steps.astype(np.uint64))), dtype=np.uint64))
                counts.append(count.astype(np.int64))
            every = np.concatenate(keys)
            order = np.argsort(every, kind="stable")
            lo, _ = runs(every[order])
            known, sums = every[order][lo], np.add.reduceat(np.concatenate(counts)[order], lo)
            del every, order
            for (chunk, check), k in zip(rows, keys, strict=True):
                answer = _squeeze(_narrow(sums[np.searchsorted(known, k)]))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([n], pa.int32()), pa.array([p], pa.int32()), pa.array([check], pa.int64()), pa.array([None], pa.list_(pa.int64())), pa.array([answer], pa.binary())], names=["chunk", "order", "part", "sum", "doc_ids", "payload"])

    chunks = texts.mapInArrow(trimmed(gather), CHUNK)
    asked = chunks.select("chunk", "payload").mapInArrow(trimmed(explode), "part int, order int, chunk long, sum long, payload binary").repartitionById(width, F.col("part")).sortWithinPartitions("part", "order", "chunk")
    answers = asked.mapInArrow(trimmed(total), "chunk long, order int, part int, sum long, doc_ids array<long>, payload binary")
    own = chunks.select("chunk", F.lit(0).alias("order"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("sum"), "doc_ids", "payload")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(stream, key=lambda r: r[0]):
            first, *rest = group
            check = zlib.crc32(first[5])
            if first[1] or any(r[3] != check for r in rest):
                raise RuntimeError("the documents changed between two scans: write them to a table first")
            sizes, vocabulary, sequence = _unsqueeze(first[5])
            index = Grams(sizes, vocabulary, sequence, key_bits, with_keys=False).index
            totals = [np.concatenate([_unsqueeze(r[5])[0] for r in rest if r[1] == n] or [np.empty(0, np.uint8)]) for n in range(1, ORDERS + 1)]
            n_words = sizes.astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(n_words)))
            cut = np.unique(np.concatenate(([0], np.searchsorted(ends[1:], np.arange(block_words, ends[-1], block_words)) + 1, [len(sizes)]))).tolist()
            blocks = [_score_block(n_words[a:b], [x[ends[a] : ends[b]] for x in index], totals, words, alpha) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            by3, by2, by1, logs = (np.concatenate(x) for x in zip(*blocks, strict=True))
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = logs / n_words
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[4], pa.int64()), pa.array(n_words), pa.array(by3), pa.array(by2), pa.array(by1), pa.array(n_words - by3 - by2 - by1), pa.array(np.where(n_words > 0, mean, 0.0), mask=n_words == 0)],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    joined = own.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", "order", "part")
    return joined.mapInArrow(trimmed(score), SCHEMA)


def _even_cuts(width: int) -> np.ndarray:
    return np.array([min((i << 64) // width, (1 << 64) - 1) for i in range(width + 1)], np.uint64)
