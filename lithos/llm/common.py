"""Helpers that the training-data operators share: scratch tables, word spans, hashes, ordering."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Texts are worked on in slices of about so many bytes, so that temporary arrays stay small.
SLICE_BYTES = 4 << 20


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lithos-{spark.sparkContext.applicationId}"
    if path not in _to_clear:
        _to_clear.add(path)
        atexit.register(_clear, spark, path)
    return path


_to_clear: set[str] = set()


def _clear(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone: the folder stays with the cluster's own clean-up
        pass


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df in as many partitions as `rows` fill, 8 at least: for tables far smaller than what the shuffles are set for."""
    return df.coalesce(max(8, -(-rows // each)))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores behind it that df has no such column, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later step reads."""
    for df in tables:
        files, spark = df.inputFiles(), df.sparkSession
        if files and shared_dir(spark).split(":", 1)[-1].lstrip("/") in files[0]:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds (ascending) that are <= value, found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    coarse = F.size(F.filter(heads, lambda b: b <= value))
    fine = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    inside = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda b: b <= value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + inside).cast("int")


def rank_distinct(df: DataFrame, column: str) -> DataFrame:
    """df's rows (one for each value of column) with __rank: their place from 0 by code point, null last.

    The sort is Spark's range sort; a row's place is its place within its partition plus the sizes of
    the partitions before it, so no task sees all rows.
    """
    placed = materialize(df.orderBy(F.col(column).asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("__at", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())  # a row for each partition
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    table = F.create_map(*[F.lit(x).cast("long") for pn in before.items() for x in pn]) if before else None
    place = F.lit(0).cast("long") if table is None else table[part] + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__rank", place).drop("__at")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, after which the worker gives free memory back: Spark keeps its Python workers, and their
    memory counts for the executor while the next stage runs."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


# ---- texts in Arrow batches ----------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Parts of a batch that hold about `most` bytes of text each; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ , and each row's first word (with the total last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = offsets[1:][offsets[1:] > 0]
    after[ends - 1] = True
    starts = np.flatnonzero(before & ~space)
    return starts, np.flatnonzero(after & ~space) + 1, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; words step through their bytes together."""
    lengths = ends - starts
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64) ^ lengths.astype(np.uint64)
    live, step = np.arange(len(starts)), 0
    while len(live):
        keep = lengths[live] > step
        live = live if keep.all() else live[keep]
        if not len(live):
            break
        if step == 48:  # the few longer ones: each by itself
            import hashlib

            for i in live:
                h[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little"))
            break
        h[live] = (h[live] ^ data[starts[live] + step]) * np.uint64(0x100000001B3)
        step += 1
    return mix64(h)


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes: a polynomial that is mixed at the end."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total *= base
        total += words[i : i + n]
    return mix64(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] items, then the next."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Input sorted by its first column, in tables that cut no group of equal values: about a batch each, or a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        last = int(changes[-1]) + 1 if len(changes) else 0
        if held and (last or held[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
