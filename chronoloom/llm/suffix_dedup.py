"""Removal of repeated byte strings by suffix arrays over shards.

Regions of one anchor hash (see ``anchors``) hold every place where a repeated window can start. A class of
regions that occurs more than once is repeated as a whole. Where an anchor hash has several classes,
one region of each goes to a shard, all of one hash to the same, and the shard's suffix array finds
the windows that classes share.

Suffixes are sorted by induction: they are classified by comparison with their successor, the
leftmost-smaller (LMS) substrings are sorted by a first induction, named, and sorted as a shorter
string by recursion, to the last level; a second induction gives the array. Where buckets are long, inductions handle a
whole bucket of one leading symbol at a time in numpy; in recursions, whose alphabets are nearly as large as their strings,
they go suffix by suffix. Both are linear. Permuted common prefixes (each suffix against its predecessor in
the array, in text order) are compared at every 16th place and carried on from there, because they fall by
at most one from a place to the next.

Defined results: null and empty texts have 0 bytes and lose nothing; a repeated row is another place where its strings
start; a row with a null doc_id loses nothing and is no other place; rows that repeat a doc_id have to
repeat its text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from chronoloom.llm.anchors import Bytes, merged, region_rows, runs, spans_of, with_texts
from chronoloom.llm.common import fresh, materialize, spread_join, trimmed

#: Suffixes a symbol from which on whole buckets are induced at a time.
LONG_BUCKETS = 128
SEPARATOR = b"\xff"


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Suffixes in order, induced from LMS suffixes in order. s ends with a unique least symbol."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    total = np.bincount(s, minlength=k)
    end = np.cumsum(total)
    front = end - total
    seeds = [lms[lo:hi] for lo, hi in _by_symbol(s[lms], k)]

    def deal(at: np.ndarray, to: np.ndarray, back: bool) -> np.ndarray:
        """Put suffixes into their buckets in order of arrival; returns those symbols' counts."""
        symbol = s[at]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        lo, hi = runs(symbol)
        rank = np.arange(len(at)) - np.repeat(lo, hi - lo)
        sa[to[symbol] - 1 - rank if back else to[symbol] + rank] = at
        count = np.bincount(symbol, minlength=k)
        if back:
            to -= count
        else:
            to += count
        return count

    head = front.copy()
    for c in range(k):
        if not total[c]:
            continue
        done = front[c]
        while done < head[c]:
            part = sa[done : head[c]]
            done = head[c]
            before = part[part > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                deal(before, head, False)
        before = seeds[c] - 1
        before = before[(before >= 0)]
        before = before[~smaller[before]]
        if len(before):
            deal(before, head, False)
    tail = end.copy()
    for c in range(k - 1, -1, -1):
        if not total[c]:
            continue
        done = end[c]
        while done > tail[c]:
            part = sa[tail[c] : done][::-1]
            done = tail[c]
            before = part[part > 0] - 1
            before = before[smaller[before]]
            if len(before):
                deal(before, tail, True)
        part = sa[front[c] : head[c]][::-1]
        before = part[part > 0] - 1
        before = before[smaller[before]]
        if len(before):
            deal(before, tail, True)
    sa[0] = n - 1
    return sa


def _by_symbol(symbols: np.ndarray, k: int) -> list[tuple[int, int]]:
    """For symbols in ascending order, where each begins and ends."""
    at = np.searchsorted(symbols, np.arange(k + 1))
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _induce_each(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """As ``_induce``, suffix by suffix, for buckets of few suffixes."""
    total = np.bincount(s, minlength=k)
    end = np.cumsum(total)
    symbol = s[lms]
    seeded = np.full(len(s), -1, np.int64)
    seeded[end[symbol] - np.searchsorted(symbol, symbol, "right") + np.arange(len(lms))] = lms
    sa, text, rises = seeded.tolist(), s.tolist(), smaller.tolist()
    to = (end - total).tolist()
    # both loops read what they have placed further on
    for p in sa:
        if p > 0 and not rises[p - 1]:
            c = text[p - 1]
            sa[to[c]] = p - 1
            to[c] += 1
    to = end.tolist()
    for p in reversed(sa):
        if p > 0 and rises[p - 1]:
            c = text[p - 1]
            to[c] -= 1
            sa[to[c]] = p - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order; s holds non-negative integers and ends with its only 0."""
    s = s.astype(np.int64)
    n, k = len(s), int(s.max()) + 1
    if n <= 2:
        return np.arange(n)[::-1].copy()
    induce = _induce if n >= LONG_BUCKETS * k else _induce_each
    # smaller than the successor: decided by the next symbol that differs
    lo, hi = runs(s)
    rises = np.append(s[hi[:-1]] > s[lo[:-1]], True)
    smaller = np.repeat(rises, hi - lo)
    smaller[-1] = True
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return induce(s, smaller, lms, k)
    first = induce(s, smaller, lms[np.argsort(s[lms], kind="stable")], k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    length = np.ones(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live, step = np.flatnonzero(same), 0
    while len(live):
        same[live[s[a[live] + step] != s[b[live] + step]]] = False
        step += 1
        live = live[same[live] & (length[a[live]] > step)]
    name = np.empty(n, np.int64)
    name[order] = np.concatenate(([0], np.cumsum(~same)))
    short = name[lms]
    if short.max() + 1 == len(lms):
        ranked = np.empty(len(lms), np.int64)
        ranked[short] = np.arange(len(lms))
    else:
        ranked = suffix_array(short)
    return induce(s, smaller, lms[ranked], k)


def permuted_prefixes(text: bytes, sa: np.ndarray, cap: int, every: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of the text its predecessor in the array (-1: none) and their common prefix, counted up to ``cap`` at least."""
    n = len(text)
    padded = text + bytes(range(16)) + bytes(cap + 32)
    words = np.ndarray((len(padded) - 8,), "<u8", padded, 0, (1,))
    sa = sa[sa < n]
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    prefix = np.zeros(n, np.int64)

    def extend(at: np.ndarray) -> None:
        limit = cap + every
        while len(at):
            room = n - np.maximum(at, before[at])
            at = at[(prefix[at] < limit) & (prefix[at] < room)]
            if not len(at):
                return
            x = words[at + prefix[at]] ^ words[before[at] + prefix[at]]
            low = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            prefix[at] = np.minimum(prefix[at] + low, n - np.maximum(at, before[at]))
            at = at[low == 8]

    whole = np.arange(n)
    known = before >= 0
    extend(whole[known & (whole % every == 0)])
    rest = whole[known & (whole % every != 0)]
    anchor = rest // every * every
    prefix[rest] = np.maximum(0, prefix[anchor] - (rest - anchor))
    # what a place has from its anchor holds against its own predecessor too
    extend(rest[prefix[rest] < cap])
    return before, prefix


def repeated_starts(parts: list[bytes], window: int) -> list[np.ndarray]:
    """For each part the starts of windows that occur elsewhere in the parts."""
    text = SEPARATOR.join(parts) + SEPARATOR
    s = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0)
    before, prefix = permuted_prefixes(text, suffix_array(s), window)
    hit = np.zeros(len(text), bool)
    again = np.flatnonzero(prefix >= window)
    hit[again] = True
    hit[before[again]] = True
    out, at = [], 0
    for p in parts:
        out.append(np.flatnonzero(hit[at : at + max(0, len(p) - window + 1)]))
        at += len(p) + 1
    return out


def repeated_spans(docs: DataFrame, window: int = 400, gram: int = 64, shard_bytes: int = 1 << 18) -> DataFrame:
    """Per document that has any, the bytes to remove: doc_id, starts and ends, which may overlap."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    rows = materialize(region_rows(docs, Bytes(window, gram)), "regions")
    classes = materialize(rows.groupBy("fp", "digest").agg(F.min(F.struct("doc_id", "lo", "hi")).alias("rep"), F.count("*").alias("times")), "classes")
    several = classes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    whole = spread_join(rows, classes.where("times > 1").select("fp", "digest", "times"), ["fp", "digest"], "times", rows.count()).selectExpr("doc_id", "lo start", f"hi + {window} end")
    wanted = classes.join(several, "fp", "left_semi").select("fp", "rep.*", (F.col("times") == 1).alias("single")).groupBy("doc_id").agg(F.collect_list(F.struct("fp", "lo", "hi", "single")).alias("regions"))

    def slices(docs_: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for doc_id, text, regions in docs_:
            for r in regions:
                data = text[r["lo"] : r["hi"] + window]
                out.append((r["fp"], doc_id, r["lo"], r["single"], data))
                size += len(data)
                if size > 8 << 20:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["fp", "doc_id", "lo", "single", "data"])

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(shard: list[tuple]) -> pa.RecordBatch | None:
            found = []
            for (_, doc_id, lo, single, _), starts in zip(shard, repeated_starts([x[4] for x in shard], window), strict=True):
                if single and len(starts):
                    found += [(doc_id, lo + a, lo + b) for a, b in merged(starts.tolist(), (starts + window).tolist())]
            if found:
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "end"])
            return None

        shard: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= shard_bytes and row[0] != shard[-1][0]:
                    if (r := solve(shard)) is not None:
                        yield r
                    shard, size = [], 0
                shard.append(row)
                size += len(row[4])
        if shard and (r := solve(shard)) is not None:
            yield r

    parts = with_texts(docs, wanted, "inner", slices, "fp long, doc_id long, lo long, single boolean, data binary")
    shared = parts.repartition("fp").sortWithinPartitions("fp", "doc_id", "lo").mapInArrow(trimmed(sort_shards), "doc_id long, start long, end long")

    return spans_of(whole.unionByName(shared))


def suffix_dedup(docs: DataFrame, window: int = 400, gram: int = 64, shard_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, and the spans themselves."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")

    def cut(docs_: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
        out = []
        for doc_id, text, starts, ends in docs_:
            gone, at, kept = merged(starts or [], ends or []), 0, hashlib.sha256()
            for a, b in gone:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append((doc_id, len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [a for a, _ in gone], [b for _, b in gone]))
            if len(out) == 2000:
                yield to_batch(out, names)
                out = []
        if out:
            yield to_batch(out, names)

    def to_batch(out: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return with_texts(docs, repeated_spans(docs, window, gram, shard_bytes), "left", cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")


def cut_texts(docs: DataFrame, window: int = 400, gram: int = 64) -> DataFrame:
    """The documents, all columns, without the repeated bytes; of a character that a cut divides nothing stays. n_chars, if there, is counted anew.

    Texts travel compressed. Columns of any name are carried along.
    """
    names = docs.columns
    place, first, last = names.index("text"), fresh(docs, "starts"), fresh(docs, "ends")
    packed_schema = StructType([StructField(f.name, BinaryType() if f.name == "text" else f.dataType, True) for f in docs.schema])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            columns = list(b.columns)
            columns[place] = pa.array([None if t is None else packer.compress(t) for t in b.column(place).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for b in batches:
            starts, ends = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            texts = []
            for packed, s, e in zip(b.column(place).to_pylist(), starts, ends, strict=True):
                data = None if packed is None else reader.decompress(packed)
                if s and data is not None:
                    kept, at = [], 0
                    for x, y in merged(s, e):
                        kept.append(data[at:x])
                        at = y
                    data = b"".join([k.decode("utf-8", "ignore").encode() for k in [*kept, data[at:]]])
                texts.append(None if data is None else data.decode())
            columns = list(b.columns[:-2])
            columns[place] = pa.array(texts, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([n if s is None or t is None else len(t) for n, s, t in zip(b.column(at).to_pylist(), starts, texts, strict=True)], b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spans = repeated_spans(docs, window, gram).select("doc_id", F.col("starts").alias(first), F.col("ends").alias(last))
    packed = docs.mapInArrow(trimmed(squeeze), packed_schema)
    return packed.join(spans.hint("merge"), "doc_id", "left").select(*names, first, last).mapInArrow(trimmed(cut), docs.schema)
