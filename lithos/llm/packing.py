"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parquet, partitions, tidy
from .encoding import END, crc32, encoded, tokenizer_path

WINDOW = 4096
#: Pieces that are differenced together; the more, the less padding a group's last windows add.
GROUP = 8192


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k parts of the items (by index) with near-equal sums.

    A partial partition is its non-empty parts, ascending. The two partitions with the largest spread
    merge, the largest part of one meeting the smallest of the other, until one is left.
    """
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    nodes: list[tuple[int, int]] = []
    n = len(sizes)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        both = len(a) + len(b) - k
        if both == 1 and len(b) == 1:
            x, y = a.pop(0), b[0]
            insort(a, (x[0] + y[0], min(x[1], y[1]), n + len(nodes)))
            nodes.append((x[2], y[2]))
            parts = a
        elif both > 0:
            # a's smallest parts meet b's largest; the rest of b meets a's empty parts
            met = []
            for x, y in zip(a[:both][::-1], b[len(b) - both :] if both < len(b) else b, strict=True):
                met.append((x[0] + y[0], min(x[1], y[1]), n + len(nodes)))
                nodes.append((x[2], y[2]))
            parts = sorted(a[both:] + met + b[: len(b) - both])
        elif len(b) == 1:
            insort(a, b[0])
            parts = a
        else:
            parts = sorted(a + b)
        spread = parts[-1][0] - (parts[0][0] if len(parts) == k else 0)
        heapq.heappush(heap, (-spread, min(i, j), parts))

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += nodes[x - n]
        return sorted(out)

    return [leaves(p[2]) for p in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Items by window; the windows rise in number, in proportion to the excess, as long as a sum exceeds the capacity. No size may exceed it."""
    k = max(1, -(-sum(sizes) // capacity))
    while sizes:
        parts = difference(sizes, k)
        most = max(sum(sizes[i] for i in p) for p in parts)
        if most <= capacity:
            return parts
        k = max(k + 1, k * most // capacity)
    return []


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def pieces(docs: DataFrame, path: str, end: int = END, capacity: int = WINDOW) -> DataFrame:
    """Each document's ids cut at multiples of the capacity; the last piece is what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, bounds in encoded(batches, "text", path, end):
            tokens = np.diff(bounds)
            n = -(-tokens // capacity)
            row = np.repeat(np.arange(len(tokens)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, tokens[row] - start)
            at = bounds[row] + start
            crc = np.array([crc32(ids[a : a + m]) for a, m in zip(at, length, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[row]))], list(_FIELDS))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES)


def pack(cut: DataFrame, n_docs: int, capacity: int = WINDOW) -> DataFrame:
    """Pieces with sequence_id and offset. Groups of GROUP pieces are packed each for itself."""
    spark = cut.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, group, held, count = TaskContext.get().partitionId(), 0, [], 0

        def flush(rows: pa.Table) -> pa.RecordBatch:
            length = rows["length"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            whole = np.flatnonzero(length == capacity)
            rest = np.flatnonzero(length < capacity)
            sequence[whole] = np.arange(len(whole))
            for w, items in enumerate(windows(length[rest].tolist(), capacity)):
                at = rest[items]
                sequence[at] = len(whole) + w
                offset[at] = np.cumsum(length[at]) - length[at]
            sequence += (p << 40) + (group << 20)
            return pa.RecordBatch.from_arrays([*(rows[f].combine_chunks() for f in _FIELDS), pa.array(sequence), pa.array(offset)], [*_FIELDS, "sequence_id", "offset"])

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, GROUP - count)
                held.append(some)
                count += some.num_rows
                batch = batch.slice(some.num_rows)
                if count == GROUP:
                    yield flush(pa.Table.from_batches(held))
                    group, held, count = group + 1, [], 0
        if count:
            yield flush(pa.Table.from_batches(held))

    # spread by content, then in a fixed order: reruns and retries give the same windows
    dealt = cut.repartition(max(1, min(-(-n_docs // GROUP), partitions(spark))), F.xxhash64(*_FIELDS)).sortWithinPartitions(*_FIELDS)
    return dealt.mapInArrow(tidy(run), PACKED)


def pack_documents(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = WINDOW) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `capacity` tokens; a row for each piece.

    A null or empty text is its end token alone; a null doc_id stays null; repeated rows are packed
    each for itself; other columns are not looked at; an empty df gives no rows.
    """
    docs = docs.select("doc_id", "text")
    return pack(pieces(docs, path or tokenizer_path(), end, capacity), docs.count(), capacity)


def op5_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(parquet(spark, sf_dir, "documents"))


QUERIES = {"op5_pack_windows": op5_pack_windows}
ORACLE_SQL: dict[str, str] = {}
