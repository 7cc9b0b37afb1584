"""Packing into fixed windows by minimum bin slack.

A document's ids (with the end id) are cut into full windows and a remainder. Remainders wait in
a pool that holds, for each length, the documents that have it. Each window takes the multiset of
remaining lengths whose sum comes closest to the capacity: a subset-sum over a bitset (one Python
integer, a shift and an OR for each binary-split count) finds the best sum, and walking the
saved bitsets backwards gives the counts. The largest remaining length always takes part, and
the same multiset is used as often as the counts allow. If the best sum still leaves slack, every
other remainder is longer than the slack, so one of them is cut to close it. What is left at the
end of a partition goes to windows of powers of two, which need no padding.

Every task packs its own documents: no shuffle, no driver state, and memory bounded by the pool.
Sequence ids carry the partition in their upper bits.

Defined results: null and empty texts are one piece with the end id alone; repeated rows and null
doc_ids are packed like any other row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from chronoloom.llm.common import trimmed
from chronoloom.llm.encoders import load_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as large as possible, at most capacity."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity and counts[x]), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    best, taken = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            taken[length] += take
    return dict(taken)


class Pool:
    """Remainders by length: each is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.sequence = window, first_sequence
        self.by_length: dict[int, list[tuple]] = defaultdict(list)
        self.total = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, of: int) -> None:
        self.by_length[len(ids)].append((doc_id, start, ids, of))
        self.total += len(ids)

    def put(self, item: tuple, offset: int, n: int) -> None:
        doc_id, start, ids, of = item
        self.out.append((doc_id, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), of, self.sequence, offset))
        self.total -= n

    def full(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Cut off whole windows; the rest joins the pool."""
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.total += self.window
            self.put((doc_id, start, ids[start:], len(ids)), 0, self.window)
            self.sequence += 1
        if whole < len(ids):
            self.add(doc_id, whole, ids[whole:].copy(), len(ids))

    def fill(self, capacity: int) -> None:
        """Windows of this capacity with one best multiset, as often as it can be taken."""
        counts = {k: len(v) for k, v in self.by_length.items() if v and k <= capacity}
        taken: dict[int, int] = {}
        if counts:
            head = max(counts)
            counts[head] -= 1
            taken = best_fill(counts, capacity - head)
            taken[head] = taken.get(head, 0) + 1
        slack = capacity - sum(k * c for k, c in taken.items())
        times = min([len(self.by_length[k]) // c for k, c in taken.items()], default=1)
        if slack:
            times = 1  # the pool changes with each cut
        for _ in range(times):
            offset = 0
            for k, c in taken.items():
                for _ in range(c):
                    self.put(self.by_length[k].pop(), offset, k)
                    offset += k
            if slack:
                donor = self.by_length[max(k for k, v in self.by_length.items() if v)].pop()
                self.put(donor, offset, slack)
                rest = donor[2][slack:]
                if len(rest):
                    self.by_length[len(rest)].append((donor[0], donor[1] + slack, rest, donor[3]))
            self.sequence += 1

    def drain(self, last: bool) -> Iterator[tuple]:
        while self.total >= self.window:
            self.fill(self.window)
        while last and self.total:
            self.fill(1 << (self.total.bit_length() - 1))
        yield from self.out
        self.out = []


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024, pool_docs: int = 16384) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens, without padding.

    ``pool_docs`` bounds how many documents a task holds before it packs them; the windows that
    are not yet full wait for the next ones.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer_path)
        pool, held = Pool(window, (TaskContext.get().partitionId() + 1) << 40), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                    pool.full(doc_id, np.append(ids, np.uint32(end_id)))
                held += batch.num_rows
                if held >= pool_docs:
                    if rows := list(pool.drain(False)):
                        yield batch_of(rows)
                    held = 0
        if rows := list(pool.drain(True)):
            yield batch_of(rows)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(trimmed(run), SCHEMA)
