"""Windows of fixed length that occur more than once, found by content-defined anchors.

Each window (so many bytes or words) has an anchor: the place in it where the hash of a short gram is least,
leftmost of ties. It depends on the window's content alone, so equal windows have the same anchor hash at
the same distance. Windows that share an anchor's place form a region; a document has about one region for each
half window length. Regions with the same anchor hash, content and shape are one class. Equal windows
always lie in classes of one anchor hash, so only hashes with several classes need a closer
look, and only one region of each class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import mix64, runs, texts_of, trimmed, window_hashes

REGION = "fp long, digest long, doc_id long, lo long, hi long"


BASE = 0x9E3779B97F4A7C15
_TABLES = {BASE: np.ones(1, np.uint64), pow(BASE, -1, 1 << 64): np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_TABLES[base]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _TABLES[base] = np.cumprod(factors, dtype=np.uint64)
    return _TABLES[base][:n]


def byte_grams(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes: prefix sums of a polynomial, each difference brought to power 0."""
    n = len(text)
    if n < k:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), dtype=np.uint64, out=total[1:])
    return mix64((total[k:] - total[:-k]) * _powers(pow(BASE, -1, 1 << 64), n - k + 1))


def regions(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of each region, where a window holds ``span`` grams."""
    n = len(grams) - span + 1
    if n < 1:
        e = np.empty(0, np.int64)
        return e, e, e
    key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(key) // span)
    table = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    table[: len(key)] = key
    table = table.reshape(rows, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo, hi = runs(at)
    return at[lo], lo, hi - 1


class Bytes:
    """Windows of so many bytes."""

    def __init__(self, window: int, gram: int) -> None:
        self.window, self.gram = window, gram

    def units(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)

    def grams(self, units: np.ndarray) -> np.ndarray:
        return byte_grams(units, self.gram)


class Words:
    """Windows of so many words, each word as its 64-bit hash."""

    def __init__(self, window: int, gram: int) -> None:
        self.window, self.gram = window, gram

    def units(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def grams(self, units: np.ndarray) -> np.ndarray:
        return window_hashes(units, self.gram)


def document_regions(units: np.ndarray, kind: Bytes | Words) -> tuple[np.ndarray, ...]:
    """fp, digest, first start and last start of a document's regions."""
    grams = kind.grams(units)
    anchor, lo, hi = regions(grams, kind.window - kind.gram + 1)
    data, width, w = units.tobytes(), units.itemsize, kind.window
    digest = np.array([xxhash.xxh3_64_intdigest(data[a * width : (b + w) * width], p - a) for p, a, b in zip(anchor.tolist(), lo.tolist(), hi.tolist(), strict=True)], np.uint64)
    return grams[anchor].view(np.int64), digest.view(np.int64), lo, hi


def region_rows(docs: DataFrame, kind: Bytes | Words) -> DataFrame:
    """All regions of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in REGION.split(", ")]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                cols: list[list[np.ndarray]] = [[] for _ in names]
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    if doc_id is None:
                        continue
                    fp, digest, lo, hi = document_regions(kind.units(text), kind)
                    for col, x in zip(cols, (fp, digest, np.full(len(fp), doc_id), lo, hi), strict=True):
                        col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names=names)

    return docs.mapInArrow(trimmed(run), REGION)


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id and the text's compressed bytes; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packer.compress(t) for t in texts_of(b)], pa.binary())], names=["doc_id", "packed"])

    return docs.mapInArrow(trimmed(run), "doc_id long, packed binary")


def with_texts(docs: DataFrame, other: DataFrame, how: str, fn: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Join per-document rows to the documents; ``fn`` gets (doc_id, text, *other columns). Texts travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        rows = ((x[0], reader.decompress(x[1]), *x[2:]) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from fn(rows)

    return squeezed(docs).join(other.hint("merge"), "doc_id", how).select("doc_id", "packed", *[c for c in other.columns if c != "doc_id"]).mapInArrow(trimmed(run), schema)


def spans_of(rows: DataFrame) -> DataFrame:
    """Per document its covered spans (start, end), as two arrays."""
    pairs = F.sort_array(F.collect_list(F.struct("start", "end")))
    return rows.groupBy("doc_id").agg(pairs.alias("s")).select("doc_id", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out
