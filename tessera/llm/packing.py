"""Best-fit packing of documents into token sequences of fixed length.

Bounded-space online best-fit: a packer holds a fixed number of open bins. A bitset keyed by free
space finds the fullest bin that still takes a piece; when all bins are open and none takes it, the
fullest bin closes and a new one opens.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import lean, materialize

LENGTH = 4096
OPEN_BINS = 512
PIECES_PER_TASK = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class BestFit:
    """Places pieces one at a time; `place` returns (bin number, offset)."""

    def __init__(self, capacity: int = LENGTH, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f is set while a bin with f free places is open
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def _pop(self, space: int) -> int:
        bins = self.bins[space]
        taken = bins.pop()
        if not bins:
            self.free ^= 1 << space
        return taken

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} doesn't go into {self.capacity}")
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._pop(space)
        else:
            if self.open == self.limit:
                self._pop((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
            number, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            if not self.bins[left]:
                self.free |= 1 << left
            self.bins[left].append(number)
        else:
            self.open -= 1
        return number, self.capacity - space


def cut(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """The pieces of every document. Only documents of more than `length` ids are cut. Null text: the end id alone."""
    source = tokens.definition(docs.sparkSession, vocabulary)

    def pieces(batches):
        encoder = tokens.worker_encoder(source.value, end_id)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc, data in zip(ids, encoder.encode(batch.column(1))):
                total = len(data) // 4
                for k, start in enumerate(range(0, total, length)):
                    part = data[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(pieces), PIECES)


def pack(docs: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK, vocabulary: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """Packs every document; a row for each piece with its sequence and its place there, gapless from 0.

    Pieces are dealt out by a hash of document and number, so a long document is no hot group; each
    task packs some `pieces_per_task` of them in hash order. An empty table gives no rows; a repeated
    row is packed as often as it comes; a null doc_id is carried as null.
    """
    found = materialize(cut(docs, length, vocabulary, end_id), "pieces")
    tasks = max(1, -(-found.count() // pieces_per_task))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = found.repartition(tasks, order).withColumn("task", F.spark_partition_id()).sortWithinPartitions(order, "doc_id", "piece")

    def place(batches):
        packer = BestFit(length, open_bins)
        for batch in batches:
            sizes, first = batch.column(3).to_pylist(), None
            if sizes:
                first = batch.column(5)[0].as_py() << 40
            placed = [packer.place(n) for n in sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return dealt.mapInArrow(lean(place), PACKED)
