"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Each task packs the documents of its partition, block by block: no shuffle, and every
block is a bounded problem of some hundred items and 32 windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import texts_of
from .common import bounded_batches
from .librarybpe import fastest_encoder, library_serves

WINDOW = 2048
#: Windows that one block fills, the longest piece it works with, and the tokens per window that it leaves free.
BLOCK_WINDOWS, PIECE, SLACK = 32, 512, 4
#: The last part of a block, in tokens per window, is cut finely: small pieces level the differences that large ones leave.
FINE, FINE_PIECES = 60, (32, 16, 8, 4)
END_ID = 1


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into k groups of near-equal sums; returns the item numbers of each group.

    Every item starts as a partial partition with one filled group. The two partitions of
    largest spread are merged with opposing imbalances, the fullest group of one with the
    emptiest of the other, until one is left.
    """
    heap = [(-s, i, [s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        merged = sorted(zip(map(int.__add__, a, reversed(b)), range(k)), reverse=True)
        groups = [x + y for x, y in zip(ga, reversed(gb))]
        low = merged[-1][0]
        sums = [s - low for s, _ in merged]
        heapq.heappush(heap, (-sums[0], serial, sums, [groups[j] for _, j in merged]))
        serial += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def balanced_windows(sizes: list[int], window: int) -> list[list[int]]:
    """Groups within the window; their number rises whenever one would exceed it."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= window for g in groups):
            return [g for g in groups if g]
        k += 1


class _Packer:
    """Packs the documents of one task; ids are little-endian unsigned 32-bit."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.piece = window, max(1, min(PIECE, window // 4))
        self.room = BLOCK_WINDOWS * (window - min(SLACK, window // 64))
        self.fine = BLOCK_WINDOWS * min(FINE, window // 16)
        self.next_sequence = first_sequence
        self.open: list[tuple] = []
        self.held = 0

    def add(self, doc: object, ids: bytes) -> Iterator[tuple]:
        """Whole windows leave at once, the rest waits in the block. A block is cut to its exact size."""
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            yield self._placed((doc, at, self.window, total, ids), 0)
            self.next_sequence += 1
            at += self.window
        while at < total:
            coarse = self.room - self.fine - self.held
            left = total - at
            if coarse > 0:
                take = min(-(-left // -(-left // self.piece)), coarse)
            else:
                take = min(FINE_PIECES[len(self.open) % len(FINE_PIECES)], left, self.room - self.held)
            self.open.append((doc, at, take, total, ids))
            self.held += take
            at += take
            if self.held == self.room:
                yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.open:
            for group in balanced_windows([x[2] for x in self.open], self.window):
                offset = 0
                for i in sorted(group):
                    yield self._placed(self.open[i], offset)
                    offset += self.open[i][2]
                self.next_sequence += 1
        self.open, self.held = [], 0

    def _placed(self, item: tuple, offset: int) -> tuple:
        doc, start, length, total, ids = item
        return doc, start, length, total, self.next_sequence, offset, ids[4 * start:4 * (start + length)]


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         end_id: int = END_ID) -> DataFrame:
    """Pieces of the tokenised documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Each document is its ids and the end id. Whole windows are cut off first; the rest is cut
    into near-equal parts of at most 512 ids, which blocks of 32 windows balance by
    differencing. A block's last 60 ids per window are cut into pieces of 4 to 32 ids, and 4 ids
    per window stay free; where the balance still exceeds the window, the block takes one
    window more. Each partition's last block is smaller.
    A sequence holds documents of one partition; its number is partition * 2^33 + counter.
    Null texts are empty and give the end id alone; null keys and repeated rows are packed like
    any other row; an empty table gives an empty result. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[key].dataType),
        *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")),
        T.StructField("ids", T.BinaryType())])
    end, library = int(end_id).to_bytes(4, "little"), library_serves(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = fastest_encoder(path, library), _Packer(window, TaskContext.get().partitionId() << 33)
        key_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            arrays = [pa.array(columns[0], key_type), *(pa.array(np.array(c, np.int64)) for c in columns[1:6]),
                      pa.array(columns[6], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, rows = batch.column(0).to_pylist(), []
            for doc, ids in zip(keys, coder.encode(texts_of(batch.column(1)))):
                rows.extend(packer.add(doc, ids + end))
            yield out(rows)
        if key_type is not None:
            yield out([*packer.close()])

    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, schema)
