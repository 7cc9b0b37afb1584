"""Sorted-string-table shards of token ids.

Layout of a shard (integers little-endian; every section is followed by one newline byte, which
belongs to the layout, because Spark's text writer, whose commit protocol makes the files safe
against lost executors, ends each row with one)::

    block*   zstd of entries: varint shared key prefix, varint key rest, varint value length,
             key rest, value. A key is 9 bytes: 0 for null or 1, then doc_id + 2^63 big-endian.
             The first key of a block is whole. A value is the ids, 2 or 4 bytes each as the footer says.
    index    per block: first key (9), last key (9), offset (8), length (4), entries (4), tokens before it in the shard (8)
    bloom    bits of a Bloom filter over the keys
    footer   80 bytes: magic, index offset and length, bloom offset, length and number of hashes,
             documents, tokens, bytes per id, crc32 of index and bloom

Shards hold disjoint ascending key ranges, so their order is that of their first keys. A lookup
reads the footer, tests the Bloom filter, searches the block index by bisection, then the block.

Defined results: null text encodes to no ids and has the end id alone; rows that repeat a doc_id are
all kept, next to each other in text order; null doc_ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, shared_dir, trimmed
from chronoloom.llm.encoders import load_encoder

MAGIC = b"LOOMSST1"
FOOTER = struct.Struct("<8sQQQQIQQII16x")
INDEX = struct.Struct("<9s9sQIIQ")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_bits(key: bytes, bits: int, hashes: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    for i in range(hashes):
        yield (a + i * b) % bits


class ShardWriter:
    """Turns entries in key order into the sections of a shard."""

    def __init__(self, width: int, block_bytes: int = 64 << 10, bits_per_key: int = 10, hashes: int = 7) -> None:
        self.width, self.block_bytes, self.bits_per_key, self.hashes = width, block_bytes, bits_per_key, hashes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.block, self.size, self.entries, self.first, self.last = [], 0, 0, b"", b""
        self.at = self.docs = self.tokens = self.before = 0
        self.index: list[bytes] = []
        self.seen: list[bytes] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> bytes | None:
        """The section to write, if this entry closes a block."""
        key, value = key_of(doc_id), ids.astype(f"<u{self.width}").tobytes()
        same = 0
        if self.entries:
            while same < 9 and key[same] == self.last[same]:
                same += 1
        else:
            self.first = key
        entry = varint(same) + varint(9 - same) + varint(len(value)) + key[same:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last, self.entries = key, self.entries + 1
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids)
        self.seen.append(key)
        return self.close() if self.size >= self.block_bytes else None

    def close(self) -> bytes | None:
        if not self.entries:
            return None
        data = self.packer.compress(b"".join(self.block))
        self.index.append(INDEX.pack(self.first, self.last, self.at, len(data), self.entries, self.before))
        self.at += len(data) + 1
        self.block, self.size, self.entries, self.before = [], 0, 0, self.tokens
        return data

    def finish(self) -> list[bytes]:
        out = [x for x in [self.close()] if x]
        index = b"".join(self.index)
        bits = max(64, len(self.seen) * self.bits_per_key)
        bloom = bytearray((bits + 7) // 8)
        for key in self.seen:
            for bit in bloom_bits(key, len(bloom) * 8, self.hashes):
                bloom[bit >> 3] |= 1 << (bit & 7)
        at = self.at + len(index) + 1
        crc = zlib.crc32(bytes(bloom), zlib.crc32(index))
        footer = FOOTER.pack(MAGIC, self.at, len(index), at, len(bloom), self.hashes, self.docs, self.tokens, self.width, crc)
        return [*out, index, bytes(bloom), footer]


class ShardReader:
    """Reads a shard through ``read(offset, length)``; a negative offset counts from the end."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self.read = read
        magic, at, size, bloom_at, bloom_size, self.hashes, self.docs, self.tokens, self.width, crc = FOOTER.unpack(read(-FOOTER.size - 1, FOOTER.size))
        index, self.bloom = read(at, size), read(bloom_at, bloom_size)
        if magic != MAGIC or zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError("not a token shard, or a damaged one")
        self.index = [INDEX.unpack_from(index, i) for i in range(0, size, INDEX.size)]

    def entries(self, block: tuple) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self.read(block[2], block[3])), 0, b""
        for _ in range(block[4]):
            same, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:same] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in self.index:
            for key, ids in self.entries(block):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key, len(self.bloom) * 8, self.hashes)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block whose last key is not below
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][1] < key else (lo, mid)
        out = []
        while lo < len(self.index) and self.index[lo][0] <= key:
            out += [ids for k, ids in self.entries(self.index[lo]) if k == key]
            lo += 1
        return out


def _vocabulary_width(tokenizer_path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path)
    return 2 if max(max(t.get_vocab(with_added_tokens=True).values()), end_id) < 1 << 16 else 4


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_bytes: int = 64 << 10) -> None:
    """Encode each text, append ``end_id`` and write shards in ascending doc_id order under ``path``.

    One range partition is one shard; adaptive execution merges small ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = load_encoder(tokenizer_path), None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                    writer = writer or ShardWriter(_vocabulary_width(tokenizer_path, end_id), block_bytes)
                    if section := writer.add(doc_id, np.append(ids, np.uint32(end_id))):
                        out.append(section)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["section"])
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array(writer.finish(), pa.binary())], names=["section"])

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    sections = ordered.mapInArrow(trimmed(run), "section binary")
    sections.select(F.col("section").cast("string").alias("value")).write.option("compression", "none").text(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry: shard, its place there (``slot``), doc_id, tokens before it in the shard, n_tokens and ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(data.as_buffer())
                if not len(data):
                    continue
                reader, at, rows = ShardReader(lambda o, n, d=data: bytes(d[o if o >= 0 else len(d) + o :][:n])), 0, []
                for slot, (doc_id, ids) in enumerate(reader):
                    rows.append((shard, slot, doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["shard", "slot", "doc_id", "before", "n_tokens", "ids_crc32"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(trimmed(run), "shard string, slot long, doc_id long, before long, n_tokens long, ids_crc32 long")


def hadoop_reader(spark: SparkSession, file: str) -> Callable[[int, int], bytes]:
    """Positioned reads of a file in any store that Spark reaches, for lookups from the driver."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(file)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(at).getLen()

    def read(offset: int, n: int) -> bytes:
        stream = fs.open(at)
        try:
            stream.seek(offset if offset >= 0 else size + offset)
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    return read


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the shards, read them back and report each document's place in the whole.

    The starts need the tokens of all earlier shards: one row per shard goes through the window.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "token-shards")
    write_token_shards(docs, path, tokenizer_path, end_id)
    rows = materialize(read_token_shards(spark, path), "token-rows")
    shards = rows.groupBy("shard").agg(F.min(F.struct("doc_id", "slot")).alias("first"), F.sum("n_tokens").alias("tokens"))
    by_key = Window.orderBy("first", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("tokens").over(by_key), F.lit(0)).alias("base"))
    return rows.join(starts, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
