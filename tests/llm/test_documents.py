"""Quality, token shards, BPE, packing, toxicity and vectors on edge cases, against plain computations."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from chronoloom.llm.bpe import bpe_round
from chronoloom.llm.lattice import near_vectors
from chronoloom.llm.packing import best_fill, pack_documents
from chronoloom.llm.quality import repetition_quality
from chronoloom.llm.registry import byte_bpe, word_bpe
from chronoloom.llm.sstable import ShardReader, hadoop_reader, token_shards, write_token_shards
from chronoloom.llm.toxicity import BlockMaxIndex, fit_toxicity, score_toxicity
from tests.llm.test_pipeline import check_pieces

TEXTS = [None, "", " ", "Hello  wORLD, it's 3 o'clock", "a", "\n\n", "日本語 🙂 e\u0301 ΑΣ", "x" * 5000, "<|endoftext|> end", "same line\nsame line\nother\nsame line", "a b c a b c a b c", "$$ ## <tag> 50%"]


def rows():
    rng = random.Random(4)
    out = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(len(out), 90):
        out.append((i, " ".join(rng.choice(["alpha", "beta", "gammas", "delta's", "ünï", "12", "x#y"]) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(rng.choice([3, 60, 400, 2500])))))
    out.append((-5, "negative"))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows()], "doc_id long, text string, slot string").repartition(3)


@pytest.mark.parametrize("op", [repetition_quality, lambda d: bpe_round(d, word_bpe()), lambda d: token_shards(d, word_bpe(), 2), lambda d: pack_documents(d, byte_bpe())])
def test_empty_and_odd_rows(docs, spark, op):
    assert op(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "x"), (3, "x"), (3, "x")], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in op(odd).collect()) == [-1, -1, 3, 3]


def test_quality(docs):
    for r in repetition_quality(docs).collect():
        text = dict(rows())[r.doc_id] or ""
        w = text.encode().split()
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(hit))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
        for n in (5, 10):
            c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            at = {i + j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(n)}
            assert r[f"dup_{n}gram_share"] == pytest.approx(sum(len(w[i].decode()) for i in at) / max(1, r.word_chars))


def test_bpe(docs):
    t = Tokenizer.from_file(word_bpe())
    for r in bpe_round(docs, word_bpe()).collect():
        ids = t.encode(dict(rows())[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_shards(docs, spark, tmp_path):
    t, at = Tokenizer.from_file(word_bpe()), 0
    got = {r.doc_id: r for r in token_shards(docs, word_bpe(), 2).collect()}
    for i, text in sorted(rows()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    write_token_shards(docs, f"{tmp_path}/shards", word_bpe(), 2, block_bytes=2000)
    readers = [ShardReader(hadoop_reader(spark, str(p))) for p in sorted((tmp_path / "shards").glob("part-*")) if p.stat().st_size]
    for i, text in rows()[:25]:
        found = [x.tolist() for r in readers for x in r.get(i)]
        assert found == [[*t.encode(text or "", add_special_tokens=False).ids, 2]]
    assert not any(r.get(12345) for r in readers)


def test_packing(docs):
    check_pieces(pack_documents(docs, byte_bpe(), 0, 256, 20).collect(), dict(rows()), byte_bpe(), 0, 256)


def test_best_fill():
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
        sums = {0}
        for k, c in counts.items():
            sums = {s + k * j for s in sums for j in range(c + 1)}
        taken = best_fill(counts, 90)
        assert sum(k * c for k, c in taken.items()) == max(s for s in sums if s <= 90) and all(c <= counts[k] for k, c in taken.items())


def test_block_max():
    rng = random.Random(5)
    vectors = [{t: rng.random() for t in rng.sample(range(40), rng.randint(1, 6))} for _ in range(500)]
    index = BlockMaxIndex(vectors, 16)
    for _ in range(40):
        q = {t: rng.random() for t in rng.sample(range(40), 3)}
        scores = sorted(((-sum(w * v.get(t, 0) for t, w in sorted(q.items())), i) for i, v in enumerate(vectors)))[:7]
        assert [(pytest.approx(-s), i) for s, i in scores if s] == index.top(q, 7)


def test_toxicity(spark):
    rng = random.Random(6)
    data = [(i, " ".join(["w%d" % rng.randint(0, 400) for _ in range(50)] + ["nasty" + rng.choice(["", "ness", "er"])] * (i % 5 == 0)), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (None, "nasty")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in data] + [(7, None, 1), (None, 1, 1)], "doc_id long, toxic int, score int")
    got = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(got) == 403
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.doc_id < 400 and r.doc_id % 5 == 0) == int(r.score >= 0.5)
    assert {r.score for r in score_toxicity(docs, fit_toxicity(docs, labels.limit(0))).collect()} == {0.0}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 64))
    data = [(i, (base[i % 12] + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.1])).astype(np.float32).tolist(), i % 2) for i in range(300)]
    data += [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] * 64, 1), (303, data[0][1], None), (304, [1.0, 2.0], 1), (305, [1.0, 2.0], 1), (306, [None, 1.0], 1)]
    x = {i: np.array(v) for i, v, y in data if i < 300 or i in (304, 305)}
    label = {i: y for i, _, y in data}
    link = {i: {j for j in x if j != i and label[i] == label[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98} for i in x}
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    for block in (2048, 7):
        got = {r.vec_id: r for r in near_vectors(df, block=block).collect()}
        assert len(got) == 307
        found, real = sum(r.n_links for r in got.values()), sum(map(len, link.values()))
        assert 0.97 * real <= found <= real and all(got[i].n_links <= len(link.get(i, ())) for i in got)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and all(got[i].component_id == i for i in (300, 301, 302, 303, 306))
    assert near_vectors(df.limit(0)).count() == 0
