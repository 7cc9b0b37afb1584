"""Exact join of documents on the Jaccard similarity of their word n-grams.

Candidates. Two sets of sizes a and b that reach the threshold differ in at most
H = (1-t)/(1+t)(a+b) shingles. Sizes are cut into bands so that partners lie in the same or the next band;
for each band pair the hash space is cut into h + k ranges (h the value of H there), so partners agree on at
least k ranges. A range's content is one signature. Signatures are counted; each document then leaves out its
k - 1 most common ones, empty ranges before all others, and still has one in common with each partner, while passages
that many documents share seldom connect them. Documents with a common signature are candidates, whose connected
components are clusters: no pair of partners is ever split between clusters. Signatures travel as packed
blocks, a block per task and partition; of those that a single set has, nothing travels on.

Joining. The different sets of a cluster form a signature tree: leaves of eight sets, each node with the OR
and the AND of its sets' bitmaps and the range of sizes. A dual traversal drops node pairs whose largest
possible overlap is too small, or that are already one component, and compares the rest exactly. Clusters of more than
``block`` sets are cut by size bands, so that a set meets only sets of a fitting size, and those into blocks, each pair of
which is a task of its own.

Copies: equal sets are one class with its least doc_id; only class representatives are compared.

Defined results: null and empty texts have the empty set, link with nothing and are their own component;
rows that repeat a doc_id each keep a row and share a component if their texts link; a null doc_id
has a null component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.anchors import squeezed
from chronoloom.llm.common import Union, connected_components, fresh, materialize, mix64, runs, shuffle_width, spread_join, texts_of, trimmed, window_hashes

K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        return window_hashes(np.append(h, np.uint64(len(words))), len(words) + 1)
    return np.unique(window_hashes(h, n))


def digest_of(u: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(u.tobytes())


class Bands:
    """Size bands for the threshold num/den and the differences that partners can have."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = [1, 2]

    def grow(self) -> None:
        # above any partner of the sizes in the band before
        self.low.append(max(self.low[-1] + 1, (self.low[-1] - 1) * self.den // self.num + 1))

    def band(self, size: int) -> int:
        while self.low[-1] <= size:
            self.grow()
        return bisect_right(self.low, size) - 1

    def differences(self, k: int) -> int:
        """Most differing shingles between a set of band k and a larger one."""
        while len(self.low) < k + 2:
            self.grow()
        a = self.low[k + 1] - 1
        return (self.den - self.num) * (a + a * self.den // self.num) // (self.den + self.num)


@lru_cache(maxsize=4096)
def cuts(m: int) -> np.ndarray:
    return np.array([(i << 64) // m for i in range(1, m)], np.uint64)


def signatures(u: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, int]]:
    """For each of a set's two band pairs its signatures and how many of the most common ones it can do without.

    Of h + k ranges, two sets at the threshold agree on k. If both drop their k - 1 most common signatures by one
    order for all, the rarest signature they share stays in both. Empty ranges rank as the most common.
    """
    top = bands.band(len(u))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(u), dtype=np.uint64)))
    out = []
    for scheme in {top, max(top - 1, 0)}:
        h = bands.differences(scheme)
        k = 1 if h == 0 else 3 + h // 4
        m = h + k
        at = np.concatenate(([0], np.searchsorted(u, cuts(m)), [len(u)]))
        count = np.diff(at).astype(np.uint64)
        sig = mix64((sums[at[1:]] - sums[at[:-1]]) * K1 + count * K2 + (np.arange(m, dtype=np.uint64) + np.uint64(scheme << 32)) * K3)
        full, empty = sig[count > 0], np.sort(sig[count == 0])
        spare = max(0, k - 1 - len(empty))
        out.append((full if len(empty) < k else np.concatenate((full, empty[: len(empty) - (k - 1)])), spare))
    return out


def _pack(keys: np.ndarray, parts: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
    """One block for each part: ids and tags with how many keys each has there, then the keys."""
    order = np.argsort(parts, kind="stable")
    keys, parts, ids, tags = keys[order], parts[order], ids[order], tags[order]
    rows, blobs = [], []
    for lo, hi in zip(*runs(parts), strict=True):
        mine, tag = ids[lo:hi], tags[lo:hi]
        a = np.concatenate(([0], np.flatnonzero((mine[1:] != mine[:-1]) | (tag[1:] != tag[:-1])) + 1))
        head = np.array([len(a), hi - lo], "<i8")
        blobs.append(head.tobytes() + mine[a].astype("<i8").tobytes() + tag[a].astype("<u4").tobytes() + np.diff(a, append=hi - lo).astype("<u4").tobytes() + keys[lo:hi].tobytes())
        rows.append(int(parts[lo]))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids, tags and keys of all blocks of a partition."""
    found = []
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            n, m = np.frombuffer(blob, "<i8", 2)
            ids, tags, count = np.frombuffer(blob, "<i8", n, 16), np.frombuffer(blob, "<u4", n, 16 + 8 * n), np.frombuffer(blob, "<u4", n, 16 + 12 * n)
            found.append((np.repeat(ids, count), np.repeat(tags, count), np.frombuffer(blob, "<u8", m, 16 + 16 * n)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else None


def candidate_edges(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) whose components keep all pairs at the threshold together."""
    width = shuffle_width(docs.sparkSession)

    def part_of(x: np.ndarray) -> np.ndarray:
        return (mix64(x.astype(np.uint64)) % np.uint64(width)).astype(np.int32)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        sigs, ids, tags, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            s, count = np.concatenate(sigs), [len(x) for x in sigs]
            return _pack(s, part_of(s), np.repeat(np.array(ids, np.int64), count), np.repeat(np.array(tags, np.uint32), count))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                u = shingles(text, n)
                if doc_id is None or not len(u) or (d := digest_of(u)) in seen:
                    continue  # a copy of what this task has sent
                seen.add(d)
                for which, (sig, spare) in enumerate(signatures(u, bands)):
                    sigs.append(sig)
                    ids.append(doc_id)
                    tags.append(2 * spare + which)
                    held += len(sig)
                if held >= 1 << 20:
                    yield flush()
                    sigs, ids, tags, held = [], [], [], 0
        if sigs:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures of two sets or more, with their frequency in the upper bits, to their documents."""
        if (got := _unpack(batches)) is None:
            return
        i, t, k = got
        order = np.argsort(k)
        k = k[order]
        lo, hi = runs(k)
        times = np.repeat(np.minimum(hi - lo, 65535).astype(np.uint64), hi - lo)
        again = times > 1
        order, k = order[again], (times[again] << np.uint64(48)) | (k[again] >> np.uint64(16))
        i, t = i[order], t[order]
        for at in range(0, len(order), 1 << 20):
            piece = slice(at, at + (1 << 20))
            by = np.lexsort((t[piece], i[piece]))
            yield _pack(k[piece][by], part_of(i[piece][by]), i[piece][by], t[piece][by])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's signatures without the most common ones that it can spare; unique ones are rarer than all here."""
        if (got := _unpack(batches)) is None:
            return
        i, t, k = got
        order = np.lexsort((k, t, i))
        i, t, k = i[order], t[order], k[order]
        new = np.flatnonzero((i[1:] != i[:-1]) | (t[1:] != t[:-1])) + 1
        lo, hi = np.concatenate(([0], new)), np.concatenate((new, [len(i)]))
        keep = np.arange(len(i)) < np.repeat(hi - (t[lo] >> 1), hi - lo)
        i, k = i[keep], k[keep]
        for at in range(0, len(i), 1 << 20):
            piece = slice(at, at + (1 << 20))
            yield _pack(k[piece], part_of(k[piece]), i[piece], np.zeros(len(i[piece]), np.uint32))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _unpack(batches)) is None:
            return
        i, _, k = got
        order = np.lexsort((i, k))
        i, k = i[order], k[order]
        lo, hi = runs(k)
        first = np.repeat(i[lo], hi - lo)
        far = i != first
        pairs = np.unique(np.column_stack((i[far], first[far])), axis=0)
        union = Union()
        for a, b in pairs.tolist():
            union.join(a, b)
        star = np.array([(x, r) for x in list(union.up) if (r := union.find(x)) != x], np.int64).reshape(-1, 2)
        if len(star):
            yield _pack(star[:, 1].astype("<u8"), part_of(star[:, 1]), star[:, 0], np.zeros(len(star), np.uint32))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _unpack(batches)) is None:
            return
        a, _, b = got
        union = Union()
        for x, y in np.unique(np.column_stack((a, b.astype(np.int64))), axis=0).tolist():
            union.join(x, y)
        rows = [(x, r) for x in list(union.up) if (r := union.find(x)) != x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

    blocks = docs
    for step in (emit, count, choose, meet):
        blocks = blocks.mapInArrow(trimmed(step), "part int, block binary").repartitionById(width, F.col("part"))
    return blocks.mapInArrow(trimmed(merge), "a long, b long")


class SignatureTree:
    """Links between sets by a dual traversal over bitmaps and sizes."""

    FAN, WORDS = 8, 32

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.num, self.den = num, den
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.sets = [sets[i] for i in self.order]
        n = len(sets)
        bits = np.zeros((n, self.WORDS), np.uint64)
        for i, u in enumerate(self.sets):
            at = (u >> np.uint64(53)).astype(np.int64)  # 2,048 bits
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        size = np.array([len(u) for u in self.sets])
        self.levels = [(bits, bits, size, size)]
        while len(self.levels[-1][0]) > 1:
            o, a, lo, hi = self.levels[-1]
            at = np.arange(0, len(o), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(o, at), np.bitwise_and.reduceat(a, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
        self.part = np.arange(n)
        self.compared = 0

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        o, a, lo, hi = self.levels[level]
        fit = (hi[i] * self.den >= lo[j] * self.num) & (hi[j] * self.den >= lo[i] * self.num)
        left = hi[i] - np.bitwise_count(a[i] & ~o[j]).sum(-1, dtype=np.int64)
        right = hi[j] - np.bitwise_count(a[j] & ~o[i]).sum(-1, dtype=np.int64)
        return fit & (np.minimum(left, right) * (self.num + self.den) >= self.num * (lo[i] + lo[j]))

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        self.compared += 1
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def forest(self) -> list[tuple[int, int]]:
        """Pairs of places in the given list: linked, and enough to connect all that is linked."""
        found, stack = [], [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                if i != j and self.part[i] != self.part[j] and self.linked(i, j):
                    self.part[self.part == self.part[j]] = self.part[i]
                    found.append((self.order[i], self.order[j]))
                continue
            span = self.FAN**level
            mine, other = self.part[i * span : (i + 1) * span], self.part[j * span : (j + 1) * span]
            if (mine == mine[0]).all() and (other == mine[0]).all():
                continue
            below = len(self.levels[level - 1][0])
            x, y = np.meshgrid(np.arange(i * self.FAN, min(below, (i + 1) * self.FAN)), np.arange(j * self.FAN, min(below, (j + 1) * self.FAN)), indexing="ij")
            x, y = x.ravel(), y.ravel()
            keep = x <= y if i == j else np.ones(len(x), bool)
            x, y = x[keep], y[keep]
            keep = self.may_link(level - 1, x, y)
            children = list(zip(x[keep].tolist(), y[keep].tolist(), strict=True))
            children.sort(key=lambda c: (c[0] != c[1], c), reverse=True)  # a node with itself first
            stack += [(level - 1, a, b) for a, b in children]
        return found


def jaccard_components(docs: DataFrame, n: int, num: int, den: int, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles and component_id, where links are Jaccard similarities of at least num/den."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(u) for u in sets], pa.int64()), pa.array([digest_of(u) if len(u) else None for u in sets], pa.binary())], names=["doc_id", "n_shingles", "digest"])

    sets = materialize(docs.mapInArrow(trimmed(measure), "doc_id long, n_shingles long, digest binary"), "sets")
    near = connected_components(candidate_edges(docs, n, num, den))
    full = sets.where("digest is not null and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.count("*").alias("times"))
    clusters = full.join(near.withColumnRenamed("id", "doc_id"), "doc_id").groupBy("digest").agg(F.min("component").alias("cluster"))
    classes = materialize(classes.join(clusters, "digest", "left"), "classes")
    members = classes.where("cluster is not null").drop("times")
    clusters_of = members.groupBy("cluster").agg(F.count("*").alias("members")).where("members > 1")
    # partners' sizes differ by at most den/num: in a large cluster a set meets its own size band and the next one
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1.001 * den / num))).cast("int")
    bands = F.when(F.col("members") > block, F.array(band, band - 1)).otherwise(F.array(F.lit(-2)))
    banded = members.join(clusters_of, "cluster").select("cluster", "rep", "digest", F.explode(bands).alias("band"))
    sizes = banded.groupBy("cluster", "band").agg(F.count("*").alias("n")).where("n > 1").select("cluster", "band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    wanted = banded.join(sizes, ["cluster", "band"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("cluster", "band", "i", "j", "rep", "digest", "packed")), strict=True))
        for _, group in groupby(rows, key=lambda r: r[:4]):
            own = {r[4]: u for r in group if digest_of(u := shingles(reader.decompress(r[6]), n)) == r[5]}
            ids, union = list(own), Union()
            for a, b in SignatureTree(list(own.values()), num, den).forest() if len(own) > 1 else ():
                union.join(ids[a], ids[b])
            star = [(x, r) for x in list(union.up) if (r := union.find(x)) != x]
            if star:
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in star], pa.int64()), pa.array([s[1] for s in star], pa.int64())], names=["a", "b"])

    paired = (
        squeezed(docs).withColumnRenamed("doc_id", "rep").join(wanted.hint("merge"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "digest", "packed")
        .repartition("cluster", "band", "i", "j").sortWithinPartitions("cluster", "band", "i", "j", "rep")
    )
    linked = connected_components(paired.mapInArrow(trimmed(link), "a long, b long")).withColumnRenamed("id", "rep")
    found = classes.join(linked, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"), "times")
    return spread_join(sets, found, ["digest"], "times", sets.count(), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, all columns, without those that link to one of a smaller doc_id. Where rows repeat a doc_id, each counts
    by its own text, in the order of doc_id and text, and of rows with the same of both one stays."""
    found = materialize(jaccard_components(docs, n, num, den), "components")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    row, place = fresh(docs, "row_number_"), fresh(docs, "place_")
    rows = materialize(docs.where("doc_id is not null").orderBy("doc_id", "text").withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), n, num, den)
    kept = rows.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), row, "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", F.sha2(F.col("text").cast("binary"), 256)).orderBy(row))
    kept = kept.withColumn(place, first).where(F.col(place) == 1)
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
