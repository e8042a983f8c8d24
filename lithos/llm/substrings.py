"""Removal of repeated 20-word windows by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, mix64, parquet, ragged, slices, _SPACE, tidy, utf8, whole_groups, window_hashes, word_hashes, word_spans
from .encoding import _gather, _offsets

WINDOW = 20
#: Words of an m-mer; a window's minimiser is the least hash among its m-mers.
MMER = 6
#: Buckets with more different strings than this are dealt out by window, not by minimiser.
BUCKET = 2000
#: Windows that a task sorts together, in whole buckets.
SORTED = 200_000

#: A document is known by its id and the hash of its text, t.
_RUNS = "m long, g long, doc_id long, t long, start int, n int"
_SPANS = "doc_id long, t long, start int, n int"
_LEAST = -(1 << 63)
#: Lower bits that give way to the m-mer's place when minimisers are compared: enough for any Arrow string.
_PLACE = np.uint64(28)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i: minima of powers of two, two of which cover the width."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def super_kmers(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, mmer: int = MMER) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one row that share a minimiser's place: minimiser, digest of the words, first window, windows.

    A window's minimiser is its m-mer with the least upper hash bits, the leftmost of equals, so that equal
    windows have it at the same offset and no run repeats a window of its own.
    hashes: of all words of the rows; first: each row's first word, and the total.
    """
    if len(hashes) < window:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = ragged(first[:-1], np.maximum(0, np.diff(first) - window + 1))
    mmers = window_hashes(hashes, mmer, 3)
    place = np.arange(len(mmers), dtype=np.uint64)
    least = _sliding_min((mmers >> _PLACE << _PLACE) | place, window - mmer + 1)[at]
    whole = window_hashes(hashes, window, 5)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = np.diff(np.append(begin, len(at)))
    rank = np.arange(len(at)) - np.repeat(begin, n)
    digest = np.add.reduceat(mix64(whole + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begin)
    return mmers[least[begin] & ((np.uint64(1) << _PLACE) - np.uint64(1))], mix64(digest + n.astype(np.uint64)), at[begin], n


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    return data, offsets, starts, ends, first


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, _, starts, ends, first = _split(part.column(2))
            m, g, at, n = super_kmers(word_hashes(data, starts, ends), first)
            row = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.view(np.int64)), pa.array(g.view(np.int64)), *(part.column(i).take(pa.array(row)) for i in (0, 1)), pa.array((at - first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["m", "g", "doc_id", "t", "start", "n"],
            )


_PACKS = "bucket long, hot boolean, doc_id long, t long, start int, n int, packed binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked-for super-k-mers of each text as packed strings: words joined by one space; in hot buckets, of one window each."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, _, starts, ends, first = _split(part.column(2))
            ids, hashes, out = part.column(0).to_pylist(), part.column(1).to_pylist(), [[] for _ in range(7)]
            for row, asked in enumerate(part.column(3).to_pylist()):
                for x in asked:
                    a = first[row] + x["start"]
                    words = [data[s:e].tobytes() for s, e in zip(starts[a : a + x["n"] + WINDOW - 1], ends[a : a + x["n"] + WINDOW - 1], strict=True)]
                    for i, k in [(i, 1) for i in range(x["n"])] if x["hot"] else [(0, x["n"])]:
                        for o, v in zip(out, (x["m"], x["hot"], ids[row], hashes[row], x["start"] + i, k, b" ".join(words[i : i + k + WINDOW - 1])), strict=True):
                            o.append(v)
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], [x.split()[0] for x in _PACKS.split(", ")])


def equal_windows(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A number for each run of `window` words; equal numbers for equal runs, exactly: ranks of doubling length are sorted."""
    ranks, have = {1: words}, 1

    def join(a: int, b: int) -> np.ndarray:
        n = len(words) - a - b + 1
        pair = ranks[a][:n].astype(np.int64) * (int(ranks[b].max()) + 1) + ranks[b][a : a + n]
        return np.unique(pair, return_inverse=True)[1]

    while 2 * have <= window:
        ranks[2 * have] = join(have, have)
        have *= 2
    done = have
    for part in sorted((p for p in ranks if p < have and (window - have) & p), reverse=True):
        ranks[done + part] = join(done, part)
        done += part
    return ranks[window]


def _later(packs: pa.Table) -> pa.RecordBatch:
    """Windows of whole buckets whose words also start earlier, as (doc_id, t, start, n)."""
    n = packs["n"].to_numpy().astype(np.int64)
    column = packs["packed"].combine_chunks().cast(pa.large_binary())
    data, offsets, starts, ends, first = _split(pa.Array.from_buffers(pa.large_string(), len(column), column.buffers(), offset=column.offset))
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(_offsets(ends - starts)), pa.py_buffer(_gather(data, starts, ends))]).dictionary_encode()
    at = ragged(first[:-1], n)
    same = equal_windows(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))[at]
    row = np.repeat(np.arange(len(n)), n)
    start = packs["start"].to_numpy().astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    doc, t = packs["doc_id"].combine_chunks().fill_null(_LEAST).to_numpy()[row], packs["t"].to_numpy()[row]
    order = np.lexsort((start, t, doc, same))
    again = np.zeros(len(row), bool)
    group = same[order]
    first_of = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(order)), 0))
    earliest = order[first_of]
    again[order] = (doc[order] != doc[earliest]) | (t[order] != t[earliest]) | (start[order] != start[earliest])
    hit = np.flatnonzero(again)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(hit)))
    ids = [packs[c].combine_chunks().take(pa.array(row[hit[begin]])) for c in ("doc_id", "t")]
    return pa.RecordBatch.from_arrays([*ids, pa.array(start[hit[begin]].astype(np.int32)), pa.array(length.astype(np.int32))], ["doc_id", "t", "start", "n"])


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by bucket. Tables of whole buckets."""
    held: list[pa.Table] = []
    windows = 0
    for table in whole_groups(batches):
        held.append(table)
        windows += int(table["n"].to_numpy().sum())
        if windows >= SORTED:
            yield _later(pa.concat_tables(held))
            held, windows = [], 0
    if held:
        yield _later(pa.concat_tables(held))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, t, start, n): n windows from word `start` on whose words also start earlier. docs: doc_id, t (hash of the text), text.

    Super-k-mers whose minimiser stands once in the corpus cannot have repeats and stop there. Of equal
    super-k-mers only the earliest need be looked into, all windows of the others being repeats; so the
    groups of copies, however large, shrink to one string each before strings travel. What is left goes
    as packed strings to the minimisers' buckets, where sorting finds equal windows by their words. Super-k-mers
    are told apart by 128 bits of hash.
    """
    spark = docs.sparkSession
    runs = docs.mapInArrow(tidy(_runs), _RUNS)
    shared = materialize(runs.groupBy("m").count().filter("count > 1").select("m"), "minimisers")
    runs = materialize(runs.join(shared, "m", "left_semi"), "superkmers")
    strings = materialize(runs.groupBy("m", "g").agg(F.min(F.struct("doc_id", "t", "start")).alias("first"), F.max("n").alias("n"), F.count("*").alias("c")), "strings")
    again = runs.join(strings.filter("c > 1").select("m", "g", "first"), ["m", "g"])
    copies = again.filter(~F.struct("doc_id", "t", "start").eqNullSafe(F.col("first"))).select("doc_id", "t", "start", "n")
    buckets = materialize(strings.groupBy("m").count().filter("count > 1").withColumnRenamed("count", "strings"), "buckets")
    asked = strings.join(buckets, "m").select(F.col("first.doc_id").alias("id"), F.col("first.t").alias("hash"), F.struct("m", F.col("first.start").alias("start"), "n", (F.col("strings") > BUCKET).alias("hot")).alias("x"))
    asked = asked.groupBy("id", "hash").agg(F.collect_list("x").alias("asked"))  # no more than the document has words
    packs = materialize(docs.join(asked, docs["doc_id"].eqNullSafe(asked["id"]) & (docs["t"] == asked["hash"])).select("doc_id", "t", "text", "asked").mapInArrow(tidy(_packs), _PACKS), "packs")
    sorted_ = packs.filter("NOT hot").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_sort_buckets), _SPANS)
    hot = packs.filter("hot").select("doc_id", "t", "start", "n", "packed")
    earliest = materialize(hot.groupBy("packed").agg(F.min(F.struct("doc_id", "t", "start")).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"), "hot")
    hot = hot.join(earliest, "packed").filter(~F.struct("doc_id", "t", "start").eqNullSafe(F.col("first"))).select("doc_id", "t", "start", "n")
    return copies.union(sorted_).union(hot)


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the array of its document's (start, n), and that column's name: one that docs does not have."""
    key, digest, name = free_names(docs, "__id", "__t", "__spans")
    spans = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text"))
    spans = spans.groupBy(F.col("doc_id").alias(key), F.col("t").alias(digest)).agg(F.collect_set(F.struct("start", "n")).alias(name))
    return docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(spans[key]) & (F.xxhash64(docs["text"]) == spans[digest]), "left").drop(key, digest), name


def kept_words(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space).

    A word goes if it is in a window of 20 words that also starts earlier: in a smaller doc_id (null is
    the smallest), or earlier in the same document. Windows are judged on the input. Texts of under 20
    words have no window; null texts have no words; rows that repeat a doc_id and its text count as one
    document; different texts of one doc_id, or of none, are documents that follow one another by the
    hash of their texts; an empty df gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, removed, texts = _cut(part.column(1), part.column(2))
                digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(removed), digests], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    cut, spans = _with_spans(docs)
    return cut.select("doc_id", "text", spans).mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words left as text; a text that loses nothing stays as it is, white space included. Columns may have any names."""
    names, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{text}"):
                _, removed, texts = _cut(part.column(text), part.column(len(names)))
                own = part.column(text)
                new = [t if n else o for n, t, o in zip(removed, texts, own.cast(pa.binary()).to_pylist(), strict=True)]
                columns = list(part.columns[: len(names)])
                columns[text] = pa.array(new, pa.binary()).cast(own.type)
                yield pa.RecordBatch.from_arrays(columns, names)

    cut, spans = _with_spans(docs)
    numbered = cut.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate((*names, spans))])  # mapInArrow takes no name with a point
    return numbered.mapInArrow(tidy(run), docs.schema)


def _cut(texts: pa.Array, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, words removed, and the words left, joined by one space, of each row."""
    data, offsets, starts, ends, first = _split(texts)
    per_row = np.array([len(x) if x is not None else 0 for x in spans.to_pylist()], np.int64) if spans.null_count < len(spans) else np.zeros(len(spans), np.int64)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(per_row)), per_row)
    a = first[row] + flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    b = np.minimum(a + flat.field("n").to_numpy(zero_copy_only=False) + WINDOW - 1, first[row + 1]) if len(row) else a
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, a, 1)
    np.add.at(depth, b, -1)
    gone = np.cumsum(depth[:-1]) > 0
    removed = np.concatenate([[0], np.cumsum(gone)])[first]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[~gone]] += 1
    stop = np.minimum(ends[~gone] + 1, offsets[1:][rows[~gone]])  # with the white space behind the word, if any
    np.subtract.at(step, stop, 1)
    keep = np.cumsum(step[:-1], dtype=np.int8) > 0
    out = data[keep]
    out[_SPACE[out]] = 32
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    texts = [out[a:b].tobytes().removesuffix(b" ") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.diff(first), np.diff(removed), texts


def op4_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_words(parquet(spark, sf_dir, "documents"))


QUERIES = {"op4_superkmer_dedup": op4_superkmer_dedup}

ORACLE_SQL = {
    "op4_superkmer_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM s),
e AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM e WHERE again),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
}
