"""Packing by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows and a rest; rests are cut into pieces of at most `PIECE` ids. The pieces of a batch
are spread over the least number of windows that could hold them: partial partitions, each a vector of window sums, are
merged two at a time, those with the largest imbalance first, the large sums of one against the small sums of the other.
If the fullest window exceeds the capacity, the number of windows rises and the differencing is done anew. A batch is
bounded by BATCH_WINDOWS, and batches are independent, so nothing is shuffled and no task holds more than its split.

Defined cases: a null text is empty and consists of the end id; repeated rows and equal ids of documents are packed like
others; null document ids stay null. Sequence ids are the partition number and a count, so they are the same when a task
is repeated.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from scholarmesh.llm.common import documents
from scholarmesh.llm.tokens import byte_bpe, public_path

WINDOW = 1024
PIECE = 256
BATCH_WINDOWS = 256
END_ID = 0
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Items of each of k near-equal groups, by multiway largest differencing."""
    left, right = [-1] * len(sizes), [-1] * len(sizes)  # trees over the items; a node beyond them joins two nodes
    heap = []
    for n, x in enumerate(sizes):
        sums, node = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[0], node[0] = x, n
        heap.append((-int(x), n, sums, node))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, a_node = heapq.heappop(heap)  # sums descending
        _, _, b, b_node = heapq.heappop(heap)
        sums, b_node = a + b[::-1], b_node[::-1]
        node = np.where(a_node < 0, b_node, a_node)
        for i in np.nonzero((a_node >= 0) & (b_node >= 0))[0]:
            node[i] = len(left)
            left.append(int(a_node[i]))
            right.append(int(b_node[i]))
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        count += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), count, sums, node))
    groups: list[list[int]] = []
    for root in heap[0][3] if heap else []:
        group, stack = [], [int(root)] if root >= 0 else []
        while stack:
            n = stack.pop()
            if n < len(sizes):
                group.append(n)
            else:
                stack += [left[n], right[n]]
        groups.append(sorted(group))
    return groups


def pack_batch(sizes: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """Items of each window; the number of windows rises until none exceeds the capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // window))
    while True:
        groups = differencing(sizes, k)
        if all(sizes[g].sum() <= window for g in groups):
            return [g for g in groups if g]
        k += 1


def pack(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, piece: int = PIECE,
         batch_windows: int = BATCH_WINDOWS) -> DataFrame:
    """Pieces of (doc_id, text) with their places in sequences of at most `window` ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []  # finished pieces
        pool: list[tuple] = []  # doc, start, length, crc, doc tokens
        pooled = 0

        def emit() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[
                x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()

        def spread() -> None:
            nonlocal sequence, pooled
            for group in pack_batch(np.array([p[2] for p in pool], dtype=np.int64), window) if pool else []:
                at = 0
                for n in group:
                    rows.append((*pool[n], sequence, at))
                    at += pool[n][2]
                sequence += 1
            pool.clear()
            pooled = 0

        last: tuple = (None, None)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text != last[0]:
                    last = (text, np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4"))
                ids = last[1]
                whole = len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    rows.append((doc, start, window, zlib.crc32(ids[start:start + window]), len(ids), sequence, 0))
                    sequence += 1
                for start in range(whole, len(ids), piece):
                    part = ids[start:start + piece]
                    pool.append((doc, start, len(part), zlib.crc32(part), len(ids)))
                    pooled += len(part)
                if pooled >= batch_windows * window:
                    spread()
                if len(rows) > 20_000:
                    yield from emit()
        spread()
        yield from emit()

    return docs.mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_path("byte_bpe_50k.json"))
