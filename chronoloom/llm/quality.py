"""Quality rules by repetition coverage.

Words are ``[^\\x20\\x09-\\x0D]+``. Windows of several lengths over the words of a text get
rolling hashes (numpy, one multiply-add per length); a window counts as duplicated if the same
words occur at another place of the same text, and coverage is the share of word characters
that lie inside duplicated windows. Hash groups are compared word by word, so a collision
can't change a count.

Defined results: null and empty texts have no words and fail the base rule; rows are scored
one by one, so repeated rows, ties in doc_id and null doc_ids keep one result row each; other
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoloom.llm.common import mix64, runs, texts_of, trimmed

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Share of word characters inside duplicated n-grams beyond which a text is rejected.
NGRAM_LIMITS = {5: 0.40, 6: 0.39, 7: 0.38, 8: 0.37, 9: 0.36, 10: 0.35}
#: The same for duplicated lines, and symbols for each word.
LINE_LIMIT, SYMBOL_LIMIT = 0.45, 0.1

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"dup_{n}gram_share double" for n in NGRAM_LIMITS)
    + ", dup_line_share double"
)


def duplicated(ids: np.ndarray, doc: np.ndarray, n: int, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Those window starts whose n words occur at another start of the same document."""
    key = mix64(hashes[starts] ^ mix64(doc[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    lo, hi = runs(key[order])
    many = hi - lo > 1
    if not many.any():
        return starts[:0]
    size = (hi - lo)[many]
    at = starts[order[np.repeat(lo[many], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]]
    first = np.repeat(starts[order[lo[many]]], size)
    same = doc[at] == doc[first]
    for j in range(n):
        same &= ids[at + j] == ids[first + j]
    if not same.all():  # a collision: compare the words themselves
        rows = np.column_stack([doc[at]] + [ids[at + j] for j in range(n)])
        _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        at = at[count[inverse.ravel()] > 1]
    return np.sort(at)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    step = np.zeros(size + 1, np.int32)
    step[starts] += 1
    np.subtract.at(step, starts + n, 1)
    return np.cumsum(step[:-1]) > 0


def line_repeats(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; characters outside white space in all lines that occur more than once."""
    count: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            count[line] = count.get(line, 0) + 1
    again = chars = 0
    for line, c in count.items():
        if c > 1:
            again += c - 1
            chars += c * len(b"".join(line.split()).decode("utf-8", "replace"))
    return again, chars


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    known: dict[bytes, int] = {}
    lengths: list[int] = []
    ids: list[int] = []
    n_words = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        n_words[i] = len(words)
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = len(lengths)
                lengths.append(len(w.decode("utf-8", "replace")))
            ids.append(k)
    word = np.array(ids, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    chars = np.array(lengths, np.int64)[word] if len(word) else np.empty(0, np.int64)
    total = np.bincount(doc, chars, len(texts)).astype(np.int64) if len(word) else np.zeros(len(texts), np.int64)
    out = {"n_words": n_words, "word_chars": total, "n_repeat_words": np.zeros(len(texts), np.int64)}
    out |= {f"dup_{n}gram_share": np.zeros(len(texts)) for n in NGRAM_LIMITS}
    g, base = mix64(word.astype(np.uint64) + np.uint64(7)), np.uint64(0x9E3779B97F4A7C15)
    h, starts = g, np.arange(len(word))
    for n in range(2, max(NGRAM_LIMITS) + 1):
        if len(word) < n:
            break
        h = h[: len(word) - n + 1] * base + g[n - 1 :]
        if n < 3:
            continue
        starts = starts[starts <= len(word) - n]
        starts = starts[doc[starts] == doc[starts + n - 1]]
        starts = duplicated(word, doc, n, h, starts)  # a longer duplicate starts where a shorter one does
        if not len(starts):
            break
        if n == 3 or n in NGRAM_LIMITS:
            hit = covered(starts, n, len(word))
            if n == 3:
                out["n_repeat_words"] = np.bincount(doc, hit, len(texts)).astype(np.int64)
            else:
                out[f"dup_{n}gram_share"] = np.bincount(doc, hit * chars, len(texts)) / np.maximum(total, 1)
    lines = [line_repeats(t) for t in texts]
    out["n_dup_lines"] = np.array([x[0] for x in lines], np.int64)
    out["dup_line_share"] = np.array([x[1] for x in lines], np.float64) / np.maximum(total, 1)
    out["n_symbols"] = np.array([sum(t.count(bytes([c])) for c in SYMBOLS) for t in texts], np.int64)
    bad = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    fine = (out["dup_line_share"] <= LINE_LIMIT) & (out["n_symbols"] <= SYMBOL_LIMIT * out["n_words"])
    for n, limit in NGRAM_LIMITS.items():
        fine &= out[f"dup_{n}gram_share"] <= limit
    return out | {"base_failed": bad, "kept": ~bad & fine}


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            found = measure(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(found[f.split()[0]]) for f in SCHEMA.split(", ")[1:]], names=[f.split()[0] for f in SCHEMA.split(", ")])


def repetition_quality(docs: DataFrame) -> DataFrame:
    """Per document the base counts, shares of duplicated text and whether it is kept."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(trimmed(_score), SCHEMA)


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield batch.filter(pa.array(measure(texts_of(batch))["kept"]))

    return docs.mapInArrow(trimmed(run), docs.schema)
