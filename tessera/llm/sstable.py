"""Sorted-string-table shards of token ids.

A shard: data blocks, a sparse index (last key, place and length of each block), a Bloom filter of the
keys, a footer of fixed length. A block holds entries in key order, keys prefix-compressed against the
one before, and is compressed and checksummed as a whole. Keys are document ids as 8 big-endian bytes
with the sign bit flipped (null: no bytes, so first). A value is the number of ids before the document
in its shard and the ids, 2 bytes each where all are below 65,536, else 4.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import file_system, lean, scratch

MAGIC = b"TSST0001"
FOOTER = struct.Struct("<QQQQQQI8s")  # index place, length; filter place, length; entries; ids; crc of index and filter
BLOCK_BYTES = 256 * 1024
SHARD_BYTES = 256 * 1024 * 1024
BITS_PER_KEY, HASHES = 10, 7

MANIFEST = "part long, shard int, path string, entries long, ids long, bytes long, first binary, last binary"


def pack_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def unpack_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % size for k in range(HASHES)]


class ShardWriter:
    """Writes entries, which come in key order, to a sink with `write`."""

    def __init__(self, sink, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.sink, self.block_bytes, self.zip = sink, block_bytes, zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.keys, self.index, self.at, self.ids = bytearray(), b"", [], [], 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys out of order")
        shared, most = 0, min(len(key), len(self.last))
        while shared < most and key[shared] == self.last[shared]:
            shared += 1
        values = np.frombuffer(ids, "<u4")
        narrow = not len(values) or int(values.max()) < 65536
        payload = values.astype("<u2").tobytes() if narrow else ids
        for n in (shared, len(key) - shared, self.ids, 2 if narrow else 4, len(values)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += payload
        self.last = key
        self.keys.append(key)
        self.ids += len(values)
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.sink.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block, self.last = bytearray(), b""

    def close(self) -> int:
        """Ends the shard; its length in bytes."""
        self.flush()
        index = bytearray()
        for key, at, length in self.index:
            for n in (len(key), at, length):
                put_varint(index, n)
            index += key
        size = max(64, len(self.keys) * BITS_PER_KEY)
        bits = np.zeros(size, bool)
        for key in self.keys:
            bits[_bits(key, size)] = True
        bloom = struct.pack("<Q", size) + np.packbits(bits).tobytes()
        tail = bytes(index) + bloom
        foot = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.ids, zlib.crc32(tail), MAGIC)
        self.sink.write(tail + foot)
        return self.at + len(tail) + len(foot)


class ShardReader:
    """Reads a shard by ranges: footer, index and filter at first, then single blocks."""

    def __init__(self, path: str):
        import zstandard

        fs, name = file_system(path)
        self.file, self.unzip = fs.open_input_file(name), zstandard.ZstdDecompressor()
        end = self.file.size()
        if end < FOOTER.size:
            raise ValueError(f"{path}: too short for a shard")
        a, n, b, m, self.entries, self.ids, crc, magic = FOOTER.unpack(self._range(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: no shard")
        tail = self._range(a, n + m)
        if zlib.crc32(tail) != crc:
            raise ValueError(f"{path}: damaged index")
        self.index, at = [], 0
        while at < n:
            size, at = get_varint(tail, at)
            place, at = get_varint(tail, at)
            length, at = get_varint(tail, at)
            self.index.append((tail[at : at + size], place, length))
            at += size
        self.size = struct.unpack_from("<Q", tail, n)[0]
        self.bloom = np.frombuffer(tail, np.uint8, offset=n + 8)

    def _range(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (7 - (b & 7)) & 1 for b in _bits(key, self.size))

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, its ids) of each entry of a block."""
        _, place, length = self.index[k]
        data = self._range(place, length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        data, at, key = self.unzip.decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            start, at = get_varint(data, at)
            width, at = get_varint(data, at)
            count, at = get_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, start, np.frombuffer(data, f"<u{width}", count, at).astype("<u4", copy=False)
            at += width * count

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document (the first of equal keys), or None; reads one block at most but for equal keys."""
        key = pack_key(doc_id)
        if not self.may_contain(key):
            return None
        for k in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            for found, _, ids in self.block(k):
                if found == key:
                    return ids
                if found > key:
                    return None
        return None


def write(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = tokens.END_ID, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenizes every document and writes shards in ascending doc_id order; returns the manifest.

    Documents are dealt out by range of doc_id. Each attempt of a task writes shards of its own names, and
    only those of the successful one are in the manifest. Null text: the end id alone; a null doc_id
    comes first; repeated rows all stay, in order of text; an empty table gives no shards.
    """
    spark = docs.sparkSession
    source, folder = tokens.definition(spark, vocabulary), folder or scratch(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id().cast("long"))

    def shards(batches):
        from pyspark import TaskContext

        encoder = tokens.worker_encoder(source.value, end_id)
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        sink = writer = name = None
        number, done = 0, []

        def end():
            size = writer.close()
            sink.close()
            done.append((part, number, f"{folder}/{name}", len(writer.keys), writer.ids, size, writer.keys[0], writer.keys[-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                if writer is None:
                    name = f"part-{part:06d}-{number:04d}-{attempt}.sst"
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer = ShardWriter(sink, block_bytes)
                writer.add(pack_key(doc), ids)
                if writer.at >= shard_bytes:
                    end()
                    writer, number = None, number + 1
        if writer is not None:
            end()
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=["part", "shard", "path", "entries", "ids", "bytes", "first", "last"])

    done = rows.mapInArrow(lean(shards), MANIFEST).collect()  # a row for each shard, not for each document
    return spark.createDataFrame(done, MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row for each shard of some hundred MB; only these rows meet in one task for the sums.
    """
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"), "bytes")
    spread = based.repartition(max(1, min(manifest.count(), 100_000)), "path")

    def entries(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(path)
                for k in range(len(reader.index)):
                    rows = [(unpack_key(key), base + start, len(ids), zlib.crc32(ids.tobytes())) for key, start, ids in reader.block(k)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.select("path", "base").mapInArrow(lean(entries), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: Iterable, doc_id: int | None) -> np.ndarray | None:
    """The ids of one document by binary search, first over the shards' keys, then in a shard.

    `manifest`: its rows, in order of part and shard. Shards whose keys meet (repeated ids) are asked one after another.
    """
    rows, key = sorted(manifest, key=lambda r: (r["part"], r["shard"])), pack_key(doc_id)
    for r in rows[bisect_left(rows, key, key=lambda r: bytes(r["last"])) :]:
        if bytes(r["first"]) > key:
            return None
        ids = ShardReader(r["path"]).get(doc_id)
        if ids is not None:
            return ids
    return None
