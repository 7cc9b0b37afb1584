"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

1. A bounded sample of labelled training rows (``max_examples``, those with the least hash of
   their doc_id) gives terms that toxic texts hold far more often than others: all that pass the test, however many.
   A term is a lower-case word or the beginning of one (4 to 7 letters), so inflected forms count together.
2. Inverse document frequencies of those terms are counted over all documents.
3. The examples form an inverted index with block maxima: postings by term, cut into blocks of
   examples, with each term's largest weight in each block. A query adds up the bounds of its terms by
   block, visits blocks by falling bound and stops when no block can reach the k-th best: the
   neighbours are exact, ties by ascending place in the index.
4. Neighbours vote with the weight 1 / (distance + 0.05); a logistic curve fitted to leave-one-out votes of the
   examples turns votes into probabilities. Texts without any term get the share of toxic
   examples among examples without any.

Only the bounded sample's terms and vectors and the index made of them reach the driver.

Defined results: null and empty texts have no terms and get that share; rows are scored one by one,
so repeated rows and null doc_ids keep one row each; null labels are left out, of several labels of
one doc_id the largest counts; without labelled rows all scores are 0; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import trimmed

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, vote double, evidence array<struct<doc_id:long,similarity:double,label:int>>"


def terms_of(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in PREFIXES if len(word) >= n]


class Vocabulary:
    """Maps words to numbers of chosen terms, with a memory of bounded size."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str) -> Counter:
        known, out = self.known, Counter()
        for w in WORD.findall(text.lower()):
            hit = known.get(w)
            if hit is None:
                if len(known) >= 100_000:
                    known.clear()
                hit = known[w] = tuple(self.terms[t] for t in terms_of(w) if t in self.terms)
            if hit:
                out.update(hit)
        return out


class BlockMaxIndex:
    """Exact top-k by dot product over sparse unit vectors."""

    def __init__(self, vectors: list[dict[int, float]], block: int = 64) -> None:
        self.block, self.size = block, len(vectors)
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, v in enumerate(vectors):
            for t, w in v.items():
                lists.setdefault(t, []).append((i, w))
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for t, rows in lists.items():
            at, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            blocks, first = np.unique(at // block, return_index=True)
            self.postings[t] = at, w, blocks, np.append(first, len(at)), np.maximum.reduceat(w, first)
        self.visited = 0

    def top(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (similarity, place) with a positive similarity, best first; place ``without`` is left out."""
        bound = np.zeros((self.size + self.block - 1) // self.block + 1)
        known = [(q, self.postings[t]) for t, q in sorted(query.items()) if t in self.postings]
        for q, p in known:
            bound[p[2]] += q * p[4]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) >= k and bound[b] * (1 + 1e-12) < -best[k - 1][0]:
                break
            self.visited += 1
            score = np.zeros(self.block)
            for q, (at, w, blocks, first, _) in known:
                i = np.searchsorted(blocks, b)
                if i < len(blocks) and blocks[i] == b:
                    part = slice(first[i], first[i + 1])
                    score[at[part] - b * self.block] += q * w[part]
            new = [(-score[i], int(b * self.block + i)) for i in np.flatnonzero(score > 0) if b * self.block + i != without]
            best = sorted(best + new)[:k]
        return [(-s, i) for s, i in best]


class Model:
    """Terms, weights, index and calibration: all that scoring needs."""

    def __init__(self, terms: list[str], idf: list[float], examples: list[tuple[int, int, dict[int, int]]], k: int) -> None:
        self.terms, self.idf, self.k = terms, idf, k
        own = [(self.vector(tf), doc_id, label) for doc_id, label, tf in examples]
        bare = [label for v, _, label in own if not v]
        # like examples next to each other make tight block maxima
        own = sorted((x for x in own if x[0]), key=lambda x: (x[2], max(x[0], key=lambda t: (x[0][t], t)), x[1]))
        self.index = BlockMaxIndex([x[0] for x in own])
        self.ids, self.labels = [x[1] for x in own], [x[2] for x in own]
        toxic, count = sum(x[1] for x in examples), len(examples)
        self.prior = toxic / count if count else 0.0
        self.bare = (sum(bare) + self.prior) / (len(bare) + 1) if examples else 0.0
        self.slope, self.shift = self.fit([self.vote(self.index.top(x[0], k, i)) for i, x in enumerate(own)], self.labels)

    def vector(self, tf: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(c)) * self.idf[t] for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = [1 / (max(0.0, 1 - s) + 0.05) for s, _ in near]
        return (sum(w * self.labels[i] for w, (_, i) in zip(weights, near, strict=True)) + self.prior) / (sum(weights) + 1)

    @staticmethod
    def fit(votes: list[float], labels: list[int]) -> tuple[float, float]:
        """A rising logistic curve through (vote, label) by Newton's method, with a small ridge."""
        if not votes:
            return 6.0, -3.0
        x = np.column_stack([np.array(votes) - 0.5, np.ones(len(votes))])
        y, beta, ridge = np.array(labels, float), np.array([6.0, 0.0]), np.array([1e-2, 1e-2])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (p - y) + ridge * (beta - [6.0, 0.0])
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), grad)
            beta = beta - np.clip(step, -3, 3)
        slope = max(float(beta[0]), 0.5)
        return slope, float(beta[1]) - 0.5 * slope

    def score(self, tf: dict[int, int]) -> tuple[float, float | None, list[tuple[int, float, int]]]:
        v = self.vector(tf)
        near = self.index.top(v, self.k) if v else []
        if not near:
            return self.bare, None, []
        vote = self.vote(near)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * vote + self.shift)))), vote, [(self.ids[i], s, self.labels[i]) for s, i in near]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = 8192, k: int = 15) -> Model:
    """Fit on labelled rows that are not held out; document frequencies come from all documents."""
    spark = docs.sparkSession
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    chosen = (
        labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    )
    # at most max_examples rows of two numbers
    sample = texts.where("text is not null").join(F.broadcast(spark.createDataFrame(chosen.toPandas(), "doc_id long, toxic int")), "doc_id")

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        bad: Counter = Counter()
        docs_, bad_docs = 0, 0
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                terms = {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}
                seen.update(terms)
                docs_ += 1
                if toxic:
                    bad.update(terms)
                    bad_docs += 1
        seen[""], bad[""] = docs_, bad_docs
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64()), pa.array([bad[t] for t in seen], pa.int64())], names=["term", "n", "toxic"])

    counted = sample.select("doc_id", "text", "toxic").mapInArrow(trimmed(count_terms), "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    whole = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    rate = whole["toxic"] / whole["n"] if whole["n"] else 0.0
    expected = F.col("n") * rate
    best = counted.where((F.col("term") != "") & (F.col("n") >= 4) & (F.col("toxic") >= 3 * expected)).withColumn("z", (F.col("toxic") - expected) / F.sqrt(expected + 1)).where("z >= 5")
    terms = [r["term"] for r in best.orderBy(F.desc("z"), "term").collect()]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, n = Vocabulary(terms), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    df.update(vocabulary.counts(text).keys())
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], names=["term", "n"])

    df = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(trimmed(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()} if terms else {}
    n = df.get(-1, 0)
    idf = [math.log((n + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(terms))]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            tf = [sorted(vocabulary.counts(t).items()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([[i for i, _ in x] for x in tf], pa.list_(pa.int32())), pa.array([[c for _, c in x] for x in tf], pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "terms", "counts"],
            )

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(trimmed(vectors), "doc_id long, toxic int, terms array<int>, counts array<int>").dropDuplicates(["doc_id"]).collect()
    examples = sorted((r["doc_id"], r["toxic"], tuple(zip(r["terms"], r["counts"], strict=True))) for r in rows)
    return Model(terms, idf, [(d, y, dict(tf)) for d, y, tf in examples], k)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Score every document's whole text with a fitted model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vocabulary = Vocabulary(m.terms)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            found = [m.score(vocabulary.counts(t or "")) for t in batch.column(2).to_pylist()]
            score = [x[0] for x in found]
            evidence = [[{"doc_id": d, "similarity": s, "label": y} for d, s, y in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array([x[1] for x in found], pa.float64()), pa.array(evidence, kind)],
                names=["doc_id", "held_out", "score", "predicted", "vote", "evidence"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(trimmed(run), SCHEMA)


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vocabulary = Vocabulary(m.terms)
        for batch in batches:
            yield batch.filter(pa.array([m.score(vocabulary.counts(t or ""))[0] < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
