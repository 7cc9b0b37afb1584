"""Suffix arrays, byte removal and word removal against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from chronoloom.llm.suffix_dedup import permuted_prefixes, repeated_starts, suffix_array, suffix_dedup
from chronoloom.llm.substring_dedup import substring_dedup


@pytest.mark.parametrize("alphabet", [1, 2, 3, 40])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in [0, 1, 2, 3, 10, 100, 700] * 6:
        s = np.append(rng.integers(1, alphabet + 1, n), 0)
        want = sorted(range(n + 1), key=lambda i: s[i:].tolist())
        assert suffix_array(s).tolist() == want
        text = bytes(s[:-1].astype(np.uint8) + 64)
        before, prefix = permuted_prefixes(text, np.array([x for x in want if x < n], np.int64), 50)
        for i in range(n):
            if before[i] >= 0:
                p = before[i]
                m = next((j for j in range(min(n - i, n - p)) if text[i + j] != text[p + j]), min(n - i, n - p))
                assert min(prefix[i], 50) == min(m, 50)


@pytest.mark.parametrize("least", [0, 1 << 30])
def test_both_inductions(least, monkeypatch):
    """Each induction alone, on strings whose recursion goes several levels deep."""
    monkeypatch.setattr("chronoloom.llm.suffix_dedup.LONG_BUCKETS", least)
    rng = np.random.default_rng(8)
    piece = rng.integers(1, 5, 200)
    for s in (np.tile([1, 2, 1, 3], 150), np.tile(piece, 4), np.concatenate([piece, rng.integers(1, 5, 300), piece[50:]]), np.array([2, 1] * 200), np.arange(400, 0, -1)):
        s = np.append(s, 0)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_repeated_starts():
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    seen = defaultdict(list)
    for i, p in enumerate(parts):
        for j in range(len(p) - 9 + 1):
            seen[p[j : j + 9]].append((i, j))
    want = {x for v in seen.values() if len(v) > 1 for x in v}
    got = {(i, int(j)) for i, a in enumerate(repeated_starts(parts, 9)) for j in a}
    assert got == want


def documents():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(20, 90)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 3000), (4, "ab" * 800), (5, text(300))]
    rows.append((6, rows[5][1]))
    rows.append((7, rows[5][1][:700] + " changed " + rows[5][1][700:]))
    for i in range(8, 60):
        parts = [text(rng.randint(0, 60)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts)), p)
        rows.append((i, "\n".join(parts)))
    rows.append((60, passages[0] + " " + passages[0] + " " + passages[0]))
    rows.append((61, rows[8][1].upper()))
    rng.shuffle(rows)
    return rows


def test_bytes(spark):
    rows, w = documents(), 60
    seen = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - w + 1):
            seen[b[j : j + w]] += 1
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - w + 1):
            if seen[b[j : j + w]] > 1:
                gone[j : j + w] = b"\1" * w
        want[i] = len(b), sum(gone), bytes(gone).replace(b"\1", b"1").replace(b"\0", b" ").split().__len__(), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, lo int").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, w, 16, 2000).collect()}
    assert got == want
    assert suffix_dedup(df.limit(0), w, 16).count() == 0


@pytest.mark.parametrize("batches,max_runs", [(1, 4), (3, 1), (4, 9)])
def test_words(spark, batches, max_runs):
    rows, w = documents(), 20
    first = {}
    for i, t in rows:
        b = (t or "").split()
        for j in range(len(b) - w + 1):
            k = tuple(b[j : j + w])
            first[k] = min(first.get(k, i), i)
    want = {}
    for i, t in rows:
        b = (t or "").split()
        gone = bytearray(len(b))
        for j in range(len(b) - w + 1):
            if first[tuple(b[j : j + w])] < i:
                gone[j : j + w] = b"\1" * w
        want[i] = len(b), sum(gone), hashlib.sha256(" ".join(c for c, g in zip(b, gone) if not g).encode()).hexdigest()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, w, 4, batches, max_runs).collect()}
    assert got == want


def test_words_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).count() == 0
