"""Stages of the corpus pipeline against plain computations, on planted documents."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline as cp
from tests.llm.test_jaccard import brute

BAD = ["idiot", "moron", "scum"]


def plant(folder, spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage, rows, labels = text(90), [], []
    for i in range(240):
        w, toxic = text(rng.randint(80, 160)), i % 4 == 3
        if toxic:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        elif i % 8 == 0:
            w[20:20] = passage
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    near = rows[1][1].split()
    near[3] = "changed"
    rows += [(240, " ".join(near), "en", "s", 0), (241, rows[2][1], "en", "s", 0), (242, "one two three " * 60, "en", "s", 0), (243, "too short", "en", "s", 0), (244, None, None, None, None)]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r for r in rows}


def test_stages(spark, tmp_path):
    rows, d = plant(str(tmp_path), spark), str(tmp_path)
    step = [spark.read.parquet(f"{d}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, step[-1], d).write.parquet(f"{d}/{i}")
        step.append(spark.read.parquet(f"{d}/{i}"))
    assert all(s.columns == step[0].columns for s in step[1:5])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in step]
    assert ids[0] - ids[1] == {242, 243, 244}
    assert ids[1] - ids[2] == {i for i in range(240) if i % 4 == 3}
    left = [(i, rows[i][1]) for i in ids[2]]
    assert ids[3] == {i for i, (_, c) in brute(left, 5, 80, 100).items() if c == i} == ids[2] - {240, 241}
    seen = defaultdict(int)
    for i in ids[3]:
        b = rows[i][1].encode()
        for j in range(len(b) - 199):
            seen[b[j : j + 200]] += 1
    want = {}
    for i in ids[3]:
        b = rows[i][1].encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        want[i] = bytes(c for c, g in zip(b, gone) if not g).decode()
    assert {r.doc_id: r.text for r in step[4].collect()} == want
    assert sum(len(t) for t in want.values()) < sum(len(rows[i][1]) for i in want)
    check_pieces(step[5].collect(), want, cp.byte_bpe(), 0, 1024)
    assert cp.run(spark, d).count() == step[5].count()


def check_pieces(pieces, texts, path, end, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert by_doc.keys() == texts.keys()
    for i, ps in by_doc.items():
        ids, at = [*t.encode(texts[i] or "", add_special_tokens=False).ids, end], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at < window and at.bit_count() == 1
