"""Token-ID output (operator 9): sorted-string-table shards of token ids by document id.

A shard holds documents in ascending key order. Layout:

    data blocks    Zstandard frames of entries; an entry is
                   varint shared key bytes, varint own key bytes, varint value bytes, own key bytes, value
    index block    per data block: varint key bytes, the last key, varint offset, varint length
    Bloom filter   bits of ten to a key, seven of them set by a key's hash
    footer         struct of offsets and lengths of index and filter, documents, token ids, and a magic word

A key is a byte 0 for null, or a byte 1 and the id as eight big-endian bytes with the sign bit flipped, so bytes sort as ids
do. A value is the ids as little-endian unsigned 16-bit integers after a byte 2, or 32-bit ones after a byte 4. Reader finds a
key through filter and index by binary search, reading one block.

Scale: documents are dealt out by ranges of (id, text hash) and sorted in their partition; a task streams its documents into
shards of at most `shard_bytes`, each under a name of its own, and only shards in the written manifest count, so retried tasks
do no harm. What goes before each shard is summed over the manifest, a row a shard.

Defined results: null text is empty and has only the end id; documents with equal ids stand in the order of their texts' hash
and text; null ids come first; an empty table gives no shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.byte_tokens import shared_encoder
from ledgerlake.llm.common import giving_back, new_folder, pick, saved, store, table

END_ID = 2
MAGIC = 0x4C4C5353
FOOTER = struct.Struct("<QQQQQQQ")
BLOCK_BYTES = 64 * 1024


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def put(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def take(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def value_of(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def bit_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(7)]


class Writer:
    """Writes one shard; add() takes keys in ascending order."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.docs = self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = value_of(ids)
        self.block += put(shared) + put(len(key) - shared) + put(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.docs += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, *self._write(self.pack(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = self._write(b"".join(put(len(k)) + k + put(a) + put(n) for k, a, n in self.index))
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in bit_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._write(FOOTER.pack(*index, self._write(bytes(bloom))[0], bits, self.docs, self.tokens, MAGIC))
        self.out.close()


class Reader:
    """Reads one shard: get() finds a document's ids, scan() gives all documents in order."""

    def __init__(self, path: str):
        files, at = store(path)
        self.file = files.open_input_file(at)
        size = self.file.size()
        index, index_bytes, bloom, self.bits, self.docs, self.tokens, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a shard of this format")
        self.bloom = self._read(bloom, (self.bits + 7) // 8)
        raw, at, self.blocks = self._read(index, index_bytes), 0, []
        while at < len(raw):
            n, at = take(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = take(raw, at)
            length, at = take(raw, at)
            self.blocks.append((key, offset, length))
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _entries(self, offset: int, length: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self.unpack(self._read(offset, length)), 0, b""
        while at < len(data):
            shared, at = take(data, at)
            own, at = take(data, at)
            size, at = take(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, offset, length in self.blocks:
            for key, value in self._entries(offset, length):
                yield id_of(key), ids_of(value)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with this id; None if there is none."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] & 1 << (p & 7) for p in bit_places(key, self.bits)):
            return None
        k = bisect_left(self.blocks, (key,))
        if k < len(self.blocks):
            for found, value in self._entries(*self.blocks[k][1:]):
                if found == key:
                    return ids_of(value)
        return None

    def close(self) -> None:
        self.file.close()


MANIFEST = "path string, first_key binary, part int, shard int, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, folder: str, *, file: str | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write the shards of all documents below folder; the manifest: a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, at = store(folder)
        files.create_dir(at, recursive=True)
        encoder, writer, part, shard = shared_encoder(file), None, TaskContext.get().partitionId(), 0

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first_key": first, "part": part, "shard": shard, "n_docs": writer.docs, "n_tokens": writer.tokens}], schema=pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                key = key_of(doc)
                if writer is None:
                    name, first = f"{part:06d}-{uuid.uuid4().hex}.sst", key
                    writer = Writer(files.open_output_stream(f"{at}/{name}"))
                writer.add(key, np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(END_ID)))
                if writer.at >= shard_bytes:
                    yield closed()
                    writer, shard = None, shard + 1
        if writer is not None:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return saved(rows.mapInArrow(giving_back(run), MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the shards."""
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)  # partitions of a range sort stand in key order
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "part", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader, rows = Reader(path), []
                for doc, ids in reader.scan():
                    rows.append((doc, base, len(ids), zlib.crc32(ids.tobytes())))
                    base += len(ids)
                reader.close()
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, placed.sparkSession.sparkContext.defaultParallelism * 4)
    return placed.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), new_folder(spark, "shards")))
