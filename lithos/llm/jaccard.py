"""Exact Jaccard join over word shingles as a metric-space join: pivots, regions, windows, recursion.

In a corpus nearly every document has distance 1 from nearly every other, so that Voronoi cells around sampled
documents would be one undivided rest. The first pivots are therefore the smallest sets there are, single
shingles. A document of n shingles has (total variation, which bounds Jaccard from below) distance
1 - 1/n from {s} if it holds s, and 1 if not; it stands in the cell of its first shingle, in one order for all
documents, rare ones first. The window of the threshold replicates it to its first n - ceil(0.8 n) + 1
shingles, and says for each how large a partner may be that it first meets there: what a document has
left from that shingle on bounds the intersection.

Regions are worked on in rounds. In the first, documents link to the nearest of their region and to
its centre, the document with the most possible links; what lies within the threshold of a centre is one
component without further pairs, so that groups of near copies cost no more than their members. The next
rounds look only at documents of different components, the nearest first and more of them each time, until none
are left. A region too large for one task is divided: Voronoi cells around sampled documents, each with the
documents that the triangle inequality does not keep out of it, again and again; where the distances are
so even that cells keep nearly everything, pairs of blocks. Distances in this step are Hamming
distances of parity sketches, which are a metric and bound the symmetric difference from below. Sketches only rule
pairs out; exact sets decide, so that the result is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, few, free_names, lower_ascii, materialize, mix64, parquet, ragged, slices, tidy, utf8, whole_groups, window_hashes, word_hashes, word_spans

SHINGLE = 5
#: Similarity in percent: documents link when 100 x intersection >= PERCENT x union.
PERCENT = 80
#: Hashed counters of how many documents hold a shingle, which only put shingles in order: 16 for each document,
#: in powers of two between these.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 24
CHUNKS = 64
#: Bits of a set's parity sketch, at least and at most: as many as the set has shingles, in powers of two. The
#: Hamming distance of two sketches bounds the symmetric difference from below; a longer one is folded to the shorter.
LEAST_BITS, MOST_BITS = 256, 65536
#: Documents that one task compares with one another; larger regions are divided.
CELL = 1024
#: Pivots of a region that is divided, at least and at most.
LEAST_PIVOTS, MOST_PIVOTS = 16, 512
#: A document goes to so many cells on average at most, or the region is compared in pairs of blocks.
REPLICAS = 3
#: Pairs and sketch words that are in memory at once.
PAIRS, WORDS = 1 << 18, 1 << 20
#: Documents that are compared with one other in one task, about.
REGION = 256


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), each once, by row and hash. A text of fewer words than a shingle is one shingle."""
    data, offsets = utf8(texts)
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets)
    words, count = word_hashes(data, starts, ends), np.diff(first)
    whole = np.maximum(0, count - SHINGLE + 1)
    hashes = [window_hashes(words, SHINGLE, 7)[ragged(first[:-1], whole)]]
    rows = [np.repeat(np.arange(len(count)), whole)]
    for n in range(1, SHINGLE):  # short texts, by their number of words
        short = np.flatnonzero(count == n)
        if len(short):
            hashes.append(window_hashes(words, n, 100 + n)[first[short]])
            rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    bits = np.uint64(max(1, len(count).bit_length()))
    key = (r.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    key, h, r = key[order], h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = key[1:] != key[:-1]
    if ((h[1:] != h[:-1]) & ~new[1:]).any():  # equal but for the lowest bits
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def _nodes(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name for each row's set."""
    total = np.zeros(n, np.uint64)
    begin = np.searchsorted(rows, np.arange(n))
    some = np.flatnonzero(np.bincount(rows, minlength=n))
    if len(some):
        total[some] = np.add.reduceat(mix64(hashes + np.uint64(0x5851F42D4C957F2D)), begin[some])
    return mix64(total + np.bincount(rows, minlength=n).astype(np.uint64))


_SUMMARY = "doc_id long, t long, node long, n long, sketch array<long>, chunk int, counts binary"


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document; at the end, the task's shingle counters in chunks."""
        names = [x.split()[0] for x in _SUMMARY.split(", ")]
        counts = np.zeros(counters, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, hashes = sets(part.column(1))
                k = part.num_rows
                np.add.at(counts, _counter(hashes, counters), np.uint32(1))
                n = np.bincount(rows, minlength=k)
                bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
                start = np.concatenate([[0], np.cumsum(bits)])
                parity = np.bincount(start[rows] + (hashes & (bits[rows] - 1).astype(np.uint64)).astype(np.int64), minlength=start[-1]) & 1
                sketch = np.packbits(parity.astype(np.uint8)).view(np.int64)
                node = pa.array(_nodes(rows, hashes, k).view(np.int64), mask=n == 0)
                lists = pa.ListArray.from_arrays(pa.array((start // 64).astype(np.int32)), pa.array(sketch))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), node, pa.array(n.astype(np.int64)), lists, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        blobs = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(CHUNKS, -1)]
        none = [pa.nulls(CHUNKS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(blobs, pa.binary())], names)

    return run


def _counter(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _order(chunks: DataFrame, counters: int, mean: float) -> np.ndarray:
    """A class of commonness (0 to 31) for each counter, from counts over all documents: a byte each."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                have = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
                total[chunk] = total[chunk] + have if chunk in total else have
        for chunk, x in total.items():
            out = np.clip(np.floor(3 * np.log2(np.maximum(x, 1) / max(mean, 1))), 0, 31).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["chunk", "classes"])

    order = np.zeros((CHUNKS, counters // CHUNKS), np.uint8)
    for r in chunks.repartition(CHUNKS, "chunk").mapInArrow(tidy(classes), "chunk int, classes binary").collect():  # MOST_COUNTERS bytes at most
        order[r["chunk"]] = np.frombuffer(r["classes"], np.uint8)
    return order.reshape(-1)


def reach(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The largest partner that a set of n shingles can link with if the first shingle that both hold is its number `at`."""
    return (100 + PERCENT) * (n - at) // PERCENT - n


# ---- regions ----

_REGION = "region long, node long, n int, reach int, sketch array<long>, component long, home int"
_FIELDS = tuple(x.split()[0] for x in _REGION.split(", "))
#: Part of a document in a region. Pairs count where one is at home in it, or the two stand in different blocks.
VISITOR, HOME, LEFT, RIGHT = 0, 1, 2, 3


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row each) folded to a number of words: words that stand that far apart are added modulo 2."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


class _Sketches:
    """Sketches of different lengths."""

    def __init__(self, column: pa.Array) -> None:
        self.flat = column.flatten().to_numpy().view(np.uint64)
        at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        self.at, self.words = at[:-1], np.diff(at)
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, words: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row in the matrix, matrix) of rows with words to `most` words, folded to `words`."""
        if words not in self.made:
            place, parts, done = np.zeros(len(self.words), np.int64), [], 0
            for w in np.unique(self.words[(self.words >= words) & (self.words <= most)]):
                rows = np.flatnonzero(self.words == w)
                parts.append(_folded(self.flat[self.at[rows][:, None] + np.arange(w)], words))
                place[rows] = done + np.arange(len(rows))
                done += len(rows)
            self.made[words] = place, np.concatenate(parts)
        return self.made[words]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hamming distances of pairs of rows whose lengths are at most a factor of two apart."""
        out = np.zeros(len(i), np.int64)
        words = np.minimum(self.words[i], self.words[j])
        for w in np.unique(words):
            place, matrix = self.of(int(w), 2 * int(w))
            some = np.flatnonzero(words == w)
            for part in np.array_split(some, max(1, -(-len(some) * int(w) // WORDS))):
                out[part] = np.bitwise_count(matrix[place[i[part]]] ^ matrix[place[j[part]]]).sum(axis=1)
        return out


def _survivors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows in whole regions that sizes, windows and sketches leave possible, and their sketches' distance."""
    region, node, n, reaches, _, component, home = (rows[f].combine_chunks() for f in _FIELDS)
    region, node, n, reaches, component, home = (x.to_numpy().astype(np.int64) for x in (region, node, n, reaches, component, home))
    sketches = _Sketches(rows["sketch"].combine_chunks())
    begin = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
    end = np.repeat(np.append(begin[1:], len(region)), np.diff(np.append(begin, len(region))))
    partners = end - np.arange(len(region)) - 1
    upto, found, a = np.cumsum(partners), [], 0
    while a < len(region):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(a, b), partners[a:b])
        j = ragged(np.arange(a, b) + 1, partners[a:b])
        ok = (n[j] <= reaches[i]) & (n[i] <= reaches[j]) & (component[i] != component[j]) & (node[i] != node[j])
        ok &= (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & ((home[i] == HOME) | (home[j] == HOME) | (home[i] + home[j] == LEFT + RIGHT))
        i, j = i[ok], j[ok]
        apart, both = sketches.apart(i, j), n[i] + n[j]
        ok = 100 * (both - apart) >= PERCENT * (both + apart)
        found.append((i[ok], j[ok], apart[ok]))
        a = b
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True))  # type: ignore[return-value]


_PAIRS = "a long, b long, left long"


def _candidates(nearest: int, centre: bool):
    """The pairs to hold against each other in this round: those in which one is among the other's `nearest`, and those
    with the region's centre. `left` is the number of possible pairs that are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            i, j, apart = _survivors(rows)
            if not len(i):
                continue
            region, node = rows["region"].to_numpy(), rows["node"].to_numpy()
            m = len(i)
            x, y = np.concatenate([i, j]), np.concatenate([j, i])
            order = np.lexsort((node[y], np.concatenate([apart, apart]), x))
            first = np.searchsorted(x[order], x[order])
            rank = np.empty(2 * m, np.int64)
            rank[order] = np.arange(2 * m) - first
            take = (rank[:m] < nearest) | (rank[m:] < nearest)
            degree = np.bincount(x, minlength=len(node))
            if centre:
                best = np.lexsort((node, -degree, region))
                centres = np.zeros(len(node), bool)
                centres[best[np.append(True, region[best][1:] != region[best][:-1])]] = True
                take |= centres[i] | centres[j]
            hub = degree[i] >= degree[j]
            a, b = np.where(hub, node[j], node[i])[take], np.where(hub, node[i], node[j])[take]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "left"])
            if len(a) < m:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([m - len(a)])], ["a", "b", "left"])

    return run


def _looked_into(rows: DataFrame, count: int, nearest: int, centre: bool) -> tuple[DataFrame, int]:
    """Candidate pairs (a, b) of regions of at most CELL documents, and the number of those left for later rounds."""
    together = few(rows.select(*_FIELDS).repartition("region").sortWithinPartitions("region"), count, 20_000)
    found = materialize(together.mapInArrow(tidy(_candidates(nearest, centre)), _PAIRS), "found")
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    pairs = found.filter("a IS NOT NULL").groupBy(low, high).agg(F.max("b").alias("b"))
    left, n = found.agg(F.sum("left"), F.count("a")).first()
    pairs = materialize(few(pairs.select(F.when(F.col("b") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("a"), "b"), n), "candidates")
    discard(found)
    return pairs, left or 0


def _blocks(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Regions for the first round: of those with over CELL documents, hashed blocks, each with the same few pivots."""
    rows = regions.join(sizes, "region").withColumns({"parts": F.ceil(F.col("k") / CELL).cast("int"), "component": F.col("node"), "home": F.lit(HOME)})
    block = F.when(F.col("parts") > 1, F.xxhash64("region", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")))).otherwise(F.col("region"))
    pivots = rows.filter((F.col("parts") > 1) & (_fraction("node", 3) * F.col("k") < LEAST_PIVOTS))
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("region", F.xxhash64("region", F.col("part").cast("long")))
    return rows.withColumn("region", block).select(*_FIELDS).union(pivots.select(*_FIELDS))


def _fraction(column: str, seed: int) -> Column:
    """A hash between 0 and 1."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(float(1 << 53))


_SPLIT = "region long, node long, n int, reach int, sketch array<long>, component long, home int, blocks boolean"


def _assigned(cell_size: int, most_replicas: float):
    """Input by part of a region, pivots first: (key, role, k, words) and the region's fields. Each document's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            keys = table["key"].to_numpy()
            bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for a, b in zip(bounds, [*bounds[1:], len(keys)], strict=True):
                part = table.slice(a, b - a).combine_chunks()
                role, k, words = part["role"].to_numpy(), int(part["k"][0].as_py()), int(part["words"][0].as_py())
                place, matrix = _Sketches(part["sketch"].chunk(0)).of(words)
                matrix, n = matrix[place], part["n"].to_numpy().astype(np.int64)
                slack = 2 * ((n + np.minimum(part["reach"].to_numpy(), 100 * n // PERCENT)) * (100 - PERCENT) // (100 + PERCENT))
                pivots, rows = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
                if not len(rows):
                    continue
                near = _distances(matrix[pivots], matrix[pivots])
                np.fill_diagonal(near, 1 << 30)
                replicas = (near <= (near.min(axis=1) + slack[pivots])[:, None]).sum(axis=1).mean() if len(pivots) > 1 else np.inf
                region, node = int(part["region"][0].as_py()), part["node"].to_numpy()
                blocks = replicas > most_replicas
                if blocks:
                    parts = -(-2 * k // cell_size)
                    own = (mix64(node.view(np.uint64) + np.uint64(77)) % np.uint64(parts)).astype(np.int64)[rows]
                    who, other = np.repeat(np.arange(len(rows)), parts), np.tile(np.arange(parts), len(rows))
                    low, high = np.minimum(own[who], other), np.maximum(own[who], other)
                    cell = low * parts + high
                    home = np.where(low == high, HOME, np.where(own[who] == low, LEFT, RIGHT))
                else:
                    out = [], [], []
                    for some in np.array_split(rows, max(1, -(-len(rows) * len(pivots) * words // WORDS))):
                        gap = _distances(matrix[some], matrix[pivots])
                        nearest = gap.argmin(axis=1)
                        x, p = np.nonzero(gap <= (gap.min(axis=1) + slack[some])[:, None])
                        for o, v in zip(out, (x + (some[0] - rows[0]), p, p == nearest[x]), strict=True):
                            o.append(v)
                    who, cell, at_home = (np.concatenate(o) for o in out)
                    home = np.where(at_home & (part["home"].to_numpy()[rows][who] == HOME), HOME, VISITOR)
                    cell = node[pivots][cell]
                name = mix64(cell.astype(np.int64).view(np.uint64) + mix64(np.array([region]).view(np.uint64) + np.uint64(3 + blocks)))
                taken = part.take(pa.array(rows[who]))
                columns = {"region": pa.array(name.view(np.int64)), "home": pa.array(home.astype(np.int32)), "blocks": pa.array(np.full(len(who), blocks))}
                names = [x.split()[0] for x in _SPLIT.split(", ")]
                yield from pa.table([columns.get(c, taken[c] if c not in columns else None) for c in names], names).combine_chunks().to_batches(10_000)

    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of regions of over CELL documents, divided until no region has more: Voronoi cells and their windows.

    A document x of the cell of p and one y that it links with, at most t apart: d(y, p) <= d(y, x) + d(x, p), and
    d(x, p) is at most d(x, q) <= t + d(y, q) for y's own pivot q; so y visits each cell whose pivot is no
    further than its own by 2 t. Where that is most cells, the region is compared in pairs of blocks.
    """
    done, level = None, 0
    while True:
        sizes = rows.groupBy("region").agg(F.count("*").alias("k"), F.min(F.size("sketch")).alias("words"))
        sizes = materialize(sizes, "sizes")
        large = sizes.filter(F.col("k") > CELL)
        if not large.limit(1).count():
            return rows if done is None else done.union(rows)
        small = rows.join(sizes.filter(F.col("k") <= CELL).select("region"), "region").select(*_FIELDS)
        done = small if done is None else done.union(small)
        parts = F.ceil(F.col("k") / (4 * CELL)).cast("int")
        large = rows.join(large, "region").withColumn("parts", parts)
        share = F.least(F.greatest(2 * F.col("k") / CELL, F.lit(LEAST_PIVOTS)), F.lit(MOST_PIVOTS))
        pivots = large.filter(_fraction("node", 7 + level) * F.col("k") < share).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "role": F.lit(0)})
        members = large.withColumns({"part": F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts")).cast("int"), "role": F.lit(1)})
        both = pivots.union(members.select(*pivots.columns)).withColumn("key", F.xxhash64("region", "part")).select("key", "role", "k", "words", *_FIELDS)
        split = materialize(both.repartition("key").sortWithinPartitions("key", "role", "node").mapInArrow(tidy(_assigned(CELL, REPLICAS)), _SPLIT), "split")
        done = done.union(split.filter("blocks").select(*_FIELDS))
        rows, level = split.filter("NOT blocks").select(*_FIELDS), level + 1


# ---- exact sets ----

_LINKS = "a long, b long, both long, either long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input by document b, that one first: (b, salt, role, node, text). Exact intersections and unions."""
    region, pivot = None, None
    for batch in batches:
        for part in slices(batch, "text"):
            rows, hashes = sets(part.column(4))
            names = _nodes(rows, hashes, part.num_rows).view(np.int64)
            bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
            b, salt, role, node = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = []
            for i in range(part.num_rows):
                if names[i] != node[i]:
                    continue  # another text under the same id
                own = hashes[bounds[i] : bounds[i + 1]]
                if (b[i], salt[i]) != region:
                    region, pivot = (b[i], salt[i]), None
                if role[i] == 0:
                    pivot = own
                elif pivot is not None:
                    at = np.searchsorted(pivot, own)
                    both = int((pivot[np.minimum(at, len(pivot) - 1)] == own).sum())
                    out.append((int(node[i]), int(b[i]), both, len(own) + len(pivot) - both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "both", "either"])


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, all_at_once: bool = False) -> DataFrame:
    """Pairs (a, b) that link, by their exact intersection and union. Each b and the documents held
    against it meet in a task; those with many are split and b goes to each part."""
    if all_at_once:
        docs = docs.hint("merge")  # a large share of the texts is wanted
    n = pairs.count()
    salts = materialize(few(pairs.groupBy("b").agg((F.ceil(F.count("*") / REGION)).cast("int").alias("parts")), n), "salts")
    wanted = pairs.select(F.col("a").alias("node")).union(salts.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "doc"), "node")
    wanted = materialize(few(wanted, n), "wanted")  # its size is then known: Spark broadcasts it where it is under the threshold
    texts = materialize(docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc"])).select("node", "text"), "texts")
    salted = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    members = salted.join(texts.withColumnRenamed("node", "a"), "a").select("b", "salt", F.lit(1).alias("role"), F.col("a").alias("node"), "text")
    pivots = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(texts.withColumnRenamed("node", "b"), "b").select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("node"), "text")
    regions = members.union(pivots).repartition("b", "salt").sortWithinPartitions("b", "salt", "role")
    links = materialize(few(regions, n, 2_000).mapInArrow(tidy(_compare), _LINKS).filter(F.col("both") * 100 >= F.col("either") * PERCENT).select("a", "b").distinct(), "links")
    discard(salts, wanted, texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b); the component is its least node. Labels spread along
    links and jump to their labels' labels, so that the rounds grow with the logarithm of a component's width."""
    n = links.count()
    ends = materialize(few(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n), "ends")
    labels = materialize(few(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), n), "labels")
    while True:
        near = ends.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").withColumn("to", F.least("component", "near"))
        up = labels.select(F.col("node").alias("to"), F.col("component").alias("up"))
        following = materialize(few(step.join(up, "to").select("node", F.least("to", "up").alias("component"), F.col("component").alias("was")), n), "labels")
        if not following.filter("component <> was").limit(1).count():
            discard(ends)
            return following.drop("was")
        labels = following.drop("was")


def _regions(docs: DataFrame, nodes: DataFrame, order, counters: int) -> DataFrame:
    """(region, node, n, reach, sketch): what shares a pivot, each set of documents once with its widest windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, hashes = sets(part.column(0))
                k = part.num_rows
                names, n = _nodes(rows, hashes, k), np.bincount(rows, minlength=k)
                rank = order.value[_counter(hashes, counters)].astype(np.uint64)
                bits = np.uint64(k.bit_length())
                key = (rows.astype(np.uint64) << (np.uint64(64) - bits)) | (rank << (np.uint64(59) - bits)) | (hashes >> (bits + np.uint64(5)))
                at = np.argsort(key)
                if (key[at[1:]] == key[at[:-1]]).any():  # ties go by the whole hash, by which the rows are sorted
                    at = np.argsort(key, kind="stable")
                rows, hashes = rows[at], hashes[at]
                place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(k))[rows]
                keep = place < (n - (PERCENT * n + 99) // 100 + 1)[rows]
                rows, hashes, place = rows[keep], hashes[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(names[rows].view(np.int64)), pa.array(reach(n[rows], place).astype(np.int32))], ["pivot", "node", "reach"])

    replicated = docs.select("text").mapInArrow(tidy(windows), "pivot long, node long, reach int")
    shared = replicated.groupBy("pivot").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("pivot")
    shared = materialize(shared, "pivots")
    members = materialize(replicated.join(shared, "pivot").groupBy("pivot", "node").agg(F.max("reach").alias("reach")), "members")
    both = F.bit_xor(F.xxhash64("node", F.lit(1))), F.bit_xor(F.xxhash64("node", F.lit(2)))
    same = members.groupBy("pivot").agg(F.xxhash64(*both, F.count("*")).alias("region"))  # pivots with the same documents
    regions = members.join(same, "pivot").groupBy("region", "node").agg(F.max("reach").alias("reach"))
    regions = materialize(regions.join(nodes.select("node", F.col("n").cast("int").alias("n"), "sketch"), "node").select("region", "node", "n", "reach", "sketch"), "regions")
    discard(shared, members)
    return regions


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the least doc_id reachable by links).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set is the distinct five-word
    shingles, the whole sequence where there are fewer words, and empty for empty and null texts, which
    link with nothing and are their own component. Documents of equal sets are one node. Rows that
    repeat a doc_id stay rows; a null doc_id is never a component's least unless it stands alone; an
    empty df gives no rows. Shingles and sets are told apart by 64-bit hashes.
    """
    return with_components(docs).select("doc_id", "n_shingles", "component_id")


def with_components(docs: DataFrame) -> DataFrame:
    """As jaccard_components(), with `component`, a number that also those documents share that have no doc_id (null: an
    empty set), and t, the hash of the text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    n_docs = docs.count()
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (16 * n_docs).bit_length()))
    read = materialize(docs.mapInArrow(tidy(_summaries(counters)), _SUMMARY), "summaries")
    summary = read.filter("chunk IS NULL").drop("chunk", "counts")
    total = summary.agg(F.sum("n")).first()[0] or 0
    order = spark.sparkContext.broadcast(_order(read.filter("chunk IS NOT NULL").select("chunk", "counts"), counters, total / counters))  # MOST_COUNTERS bytes at most
    nodes = summary.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(few(nodes, n_docs, 10_000), "nodes")
    regions = _regions(docs, nodes, order, counters)
    order.unpersist()

    sizes = regions.groupBy("region").agg(F.count("*").alias("k"))
    pairs, _ = _looked_into(_blocks(regions, sizes), regions.count(), 2, True)
    links = _verified(docs, pairs, nodes, all_at_once=True)
    labels = components(links)
    nearest, left = 8, 1
    while left:  # later rounds: documents of other components
        placed = regions.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = placed.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("region")
        rows = materialize(placed.join(apart, "region").withColumn("home", F.lit(HOME)).select(*_FIELDS), "placed")
        pairs, left = _looked_into(_divided(rows), rows.count(), nearest, False)
        more = _verified(docs, pairs, nodes) if pairs.limit(1).count() else None
        if more is not None and more.limit(1).count():
            links = links.union(more)
            labels = components(links)
        discard(rows, pairs)
        nearest *= 8

    named = summary.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).select("doc_id", "t", F.col("n").alias("n_shingles"), "component")
    named = materialize(few(named, n_docs), "named")
    discard(read, nodes, regions)
    smallest = materialize(few(named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).filter("k > 1").drop("k"), n_docs), "smallest")
    return named.join(smallest, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "component", "t")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (null last), of several texts of that id the one
    with the least hash, and of rows that repeat both the first by their other columns.

    Texts without words link with nothing and stay, repeated rows of them as well. Which rows go is a narrow table,
    which Spark broadcasts where it is small; only rows that repeat id and text meet by these.
    """
    named = materialize(with_components(docs).filter("component IS NOT NULL").select("component", "doc_id", "t"), "components")
    first = named.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "t")).alias("x"))
    others = named.join(first.select("component", F.col("x.doc_id").alias("id"), F.col("x.t").alias("own")), "component")
    others = others.filter(~(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("own")))).select("doc_id", "t").distinct()
    again = named.groupBy("doc_id", "t").count().filter("count > 1").select("doc_id", "t")
    marked = materialize(others.withColumn("goes", F.lit(True)).union(again.join(others, again["doc_id"].eqNullSafe(others["doc_id"]) & (again["t"] == others["t"]), "left_anti").withColumn("goes", F.lit(False))), "marked")
    mark, place = free_names(docs, "__m", "__n")
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}.doc_id")) & (F.xxhash64("text") == F.col(f"{mark}.t"))
    joined = docs.join(marked.select(F.struct("doc_id", "t", "goes").alias(mark)), key, "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    order = Window.partitionBy(mark).orderBy(F.to_json(F.struct(*own)))
    repeated = joined.filter(~F.col(f"{mark}.goes")).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return joined.filter(F.col(mark).isNull()).select(*own).union(repeated.select(*own))


def op9_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(parquet(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_regions": op9_jaccard_regions}

ORACLE_SQL = {
    "op9_jaccard_regions": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM x),
t AS (SELECT doc_id, unnest(s) AS g FROM x),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v WHERE r.root < e.b)
SELECT n.doc_id, n.n_shingles, min(root) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY ALL
"""
}
