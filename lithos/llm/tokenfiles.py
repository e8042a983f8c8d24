"""Token ids as Arrow files of fixed-size-list batches: equal-length sequences and their masks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parquet, partitions, scratch, tidy
from .encoding import END, crc32, encoded, tokenizer_path

LENGTH = 2048
#: Sequences in a record batch.
BATCH = 256

MANIFEST = "shard int, tokens_path string, index_path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sequence_schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("input_ids", pa.list_(ids, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """One shard: a file of sequences and one of its documents' spans."""

    def __init__(self, folder: str, name: str, length: int, ids: pa.DataType) -> None:
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.paths = f"{folder}/{name}.tokens.arrow", f"{folder}/{name}.index.arrow"
        self.schema, self.length, self.ids = sequence_schema(length, ids), length, ids
        self.files = [self.fs.open_output_stream(f"{root}/{p.rsplit('/', 1)[1]}") for p in self.paths]
        self.tokens, self.index = pa.ipc.new_file(self.files[0], self.schema), pa.ipc.new_file(self.files[1], _INDEX)
        self.held, self.count, self.docs, self.total = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(bounds[:-1] + self.total), pa.array(np.diff(bounds))], schema=_INDEX))
        self.docs += len(doc_ids)
        self.total += len(ids)
        self.held.append(ids.astype(self.ids.to_pandas_dtype()))
        self.count += len(ids)
        if self.count >= BATCH * self.length:
            self._flush(self.count // self.length)

    def _flush(self, rows: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.ids.to_pandas_dtype())
        real = min(len(flat), rows * self.length)
        self.held = [flat[real:]]
        self.count = len(flat) - real
        flat = np.concatenate([flat[:real], np.zeros(rows * self.length - real, flat.dtype)])
        mask = np.arange(len(flat)) < real
        for a in range(0, rows, BATCH):
            part = slice(a * self.length, min(rows, a + BATCH) * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(flat[part], self.ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask[part]), self.length)]
            self.tokens.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.count:
            self._flush(-(-self.count // self.length))
        for x in (self.tokens, self.index, *self.files):
            x.close()


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END, length: int = LENGTH) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order to Arrow files; returns their manifest.

    Shards follow one another in doc_id order (null first). Each cuts its id stream into rows of
    `length`; only a shard's last row has padding, where the mask is false. Ids are 16 bits wide where
    the vocabulary allows it. Each attempt of a task writes files of its own name, and the manifest
    lists those of the attempt that ended, so that lost executors and retries leave no wrong data.
    A null or empty text is its end token alone; repeated rows are written each; an empty df gives no files.
    """
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, path or tokenizer_path()
    ids = pa.uint16() if max(Tokenizer.from_file(path).get_vocab_size(), end + 1) <= 1 << 16 else pa.uint32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, TaskContext.get().partitionId()
        for part, got, bounds in encoded(batches, "text", path, end):
            writer = writer or _Writer(folder, f"{shard:06d}-{uuid.uuid4().hex[:8]}", length, ids)
            writer.add(part.column(0), got, bounds)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "tokens_path": writer.paths[0], "index_path": writer.paths[1], "n_docs": writer.docs, "n_tokens": writer.total}], pa.schema([("shard", pa.int32()), ("tokens_path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(tidy(run), MANIFEST), "manifest")


def open_tokens(path: str) -> pa.ipc.RecordBatchFileReader:
    """A file of sequences for random access: memory-mapped, so zero-copy, where the path is local."""
    fs, name = filesystem(path)
    return pa.ipc.open_file(pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of row i; the ids are a view of the file."""
    batch = reader.get_batch(i // BATCH) if reader.num_record_batches else None
    ids, mask = batch.column(0), batch.column(1)
    n, at = ids.type.list_size, i % BATCH
    return ids.values.to_numpy()[at * n : (at + 1) * n], mask.values.slice(at * n, n).to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    before, total = {}, 0
    for shard, n in sorted((r[0], r[1]) for r in manifest.select("shard", "n_tokens").collect()):  # a row for each shard
        before[shard], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _spans(row["tokens_path"], row["index_path"], before[row["shard"]])

    return manifest.repartition(max(1, len(before)), "shard").mapInArrow(tidy(run), DOCUMENTS)


def _spans(tokens_path: str, index_path: str, before: int) -> Iterator[pa.RecordBatch]:
    tokens, index = open_tokens(tokens_path), open_tokens(index_path)
    row, at, ids = -1, 0, np.zeros(0, np.uint32)  # ids of batch `row`, the first of which is the shard's id number `at`

    def following() -> None:
        nonlocal row, at, ids
        at, row = at + len(ids), row + 1
        batch = tokens.get_batch(row)
        ids = batch.column(0).values.to_numpy()[batch.column(1).values.to_numpy(zero_copy_only=False)]

    for b in range(index.num_record_batches):
        part = index.get_batch(b)
        crcs = []
        for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            crc = 0
            while n:
                while start >= at + len(ids):
                    following()
                some = ids[start - at : start - at + n]
                crc, start, n = crc32(some, crc), start + len(some), n - len(some)
            crcs.append(crc)
        starts = pa.array(part.column(1).to_numpy() + before)
        yield pa.RecordBatch.from_arrays([part.column(0), starts, part.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_tokens(parquet(spark, sf_dir, "documents"), scratch(spark, "tokens")))


QUERIES = {"op7_token_files": op7_token_files}
ORACLE_SQL: dict[str, str] = {}
