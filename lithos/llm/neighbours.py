"""Approximate nearest neighbours: low-dimensional stable projections in kd-trees, with a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, parquet, tidy

#: Dimensions of the projection; even, for the closed form of the chi-square distribution.
DIMS = 8
#: Probability with which the stopping test leaves no nearer neighbour behind.
SURE = 0.97
#: Rows that fit the tree of cells, those with the least hash of their id; then rows of each cell that has over 2 x PART
#: rows, which fit a tree of its own. Every row is indexed.
SAMPLE, CELL_SAMPLE = 20_000, 4096
#: Rows of a cell, or of a part of it where its trees give no more cells, and queries of a block, about.
PART = 8192
BLOCK = 4096
#: Sampled rows of a cell at least.
LEAST = 16
LEAF = 64

_INDEX = "vec_id long, projected array<double>, vector array<{}>, norm double"
_FOUND = "query_id long, vec_id long, score double"


def chi2_quantile(p: float, dims: int) -> float:
    """The x below which chi-square with an even number of degrees of freedom falls with probability p."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid) < p else (lo, mid)
    return hi


def projection(dim: int, seed: int = 11) -> np.ndarray:
    """Gaussian, so 2-stable: projected squared distances are chi-square distributed multiples of the true ones."""
    return np.random.default_rng(seed).standard_normal((dim + 1, DIMS))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def split(points: np.ndarray, most: int) -> tuple[list[np.ndarray], list[tuple]]:
    """A kd-tree's leaves (row numbers) and its splits in preorder: (dimension, value) or None for a leaf.

    The widest dimension is cut at its median; a node whose points are all equal stays whole.
    """
    leaves, tree, todo = [], [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        part = points[rows]
        width = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(points.shape[1])
        d = int(width.argmax())
        if len(rows) <= most or width[d] == 0:
            leaves.append(rows)
            tree.append(None)
            continue
        value = float(np.median(part[:, d]))
        left = part[:, d] < value
        if not left.any():
            value = float(np.nextafter(value, np.inf))
            left = part[:, d] < value
        tree.append((d, value))
        todo += [rows[~left], rows[left]]
    return leaves, tree


class Cells:
    """A kd-tree over projections whose leaves are the cells; a cell can be given a tree of its own."""

    def __init__(self, tree: list[tuple | None], dims: int = DIMS) -> None:
        self.dims = dims
        self.nodes: list[list] = []  # dimension, value, left, right; a leaf has dimension -1
        self._graft(tree)
        self._freeze()

    def _graft(self, tree: list[tuple | None], at: int | None = None) -> None:
        """Adds the preorder tree as a new root, or in place of the leaf `at`."""
        open_: list[tuple[int, int]] = []
        for k, node in enumerate(tree):
            here = at if k == 0 and at is not None else len(self.nodes)
            if here == len(self.nodes):
                self.nodes.append([-1, 0.0, -1, -1])
            if k:
                parent, side = open_.pop()
                self.nodes[parent][side] = here
            if node is not None:
                self.nodes[here][:2] = node
                open_ += [(here, 3), (here, 2)]

    def _freeze(self) -> None:
        self.dim, self.value, self.left, self.right = (np.array([n[i] for n in self.nodes]) for i in range(4))
        n = len(self.nodes)
        self.low, self.high = np.full((n, self.dims), -np.inf), np.full((n, self.dims), np.inf)
        todo = [0]
        while todo:
            x = todo.pop()
            if self.dim[x] >= 0:
                for y in (self.left[x], self.right[x]):
                    self.low[y], self.high[y] = self.low[x], self.high[x]
                self.high[self.left[x], self.dim[x]] = self.low[self.right[x], self.dim[x]] = self.value[x]
                todo += [self.left[x], self.right[x]]

    def refined(self, trees: dict[int, list[tuple | None]]) -> Cells:
        for leaf, tree in trees.items():
            self._graft(tree, leaf)
        self._freeze()
        return self

    def home(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), np.int64)
        live = np.flatnonzero(self.dim[at] >= 0)
        while len(live):
            x = at[live]
            at[live] = np.where(points[live, self.dim[x]] < self.value[x], self.left[x], self.right[x])
            live = live[self.dim[at[live]] >= 0]
        return at

    def within(self, points: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of all cells whose squared distance to the point is `most` or less; other branches are not entered."""
        who, at = np.arange(len(points)), np.zeros(len(points), np.int64)
        out = []
        while len(who):
            p = points[who]
            gap = np.maximum(np.maximum(self.low[at] - p, p - self.high[at]), 0)
            keep = (gap * gap).sum(axis=1) <= most[who]
            who, at = who[keep], at[keep]
            leaf = self.dim[at] < 0
            out.append((who[leaf], at[leaf]))
            who, at = np.tile(who[~leaf], 2), np.concatenate([self.left[at[~leaf]], self.right[at[~leaf]]])
        return np.concatenate([w for w, _ in out] or [who]), np.concatenate([x for _, x in out] or [at])


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
        out += gap * gap
    return out


class Part:
    """Rows of a part in a kd-tree over their projections.

    Of equal vectors only the `keep` smallest ids can be among a query's `keep` nearest; the others are left out.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, keep: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors, projected = ids[order], np.ascontiguousarray(vectors[order]), projected[order]
        _, same = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).reshape(-1), return_inverse=True)
        by = np.argsort(same, kind="stable")
        begin = np.flatnonzero(np.append(True, same[by][1:] != same[by][:-1]))
        place = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
        rows = np.sort(by[place < keep])
        leaves, _ = split(projected[rows], LEAF)
        order = rows[np.concatenate(leaves)]
        self.ids, self.vectors, self.projected = ids[order], vectors[order], projected[order]
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.low = np.array([self.projected[a:b].min(axis=0) for a, b in zip(self.at, self.at[1:], strict=False)])
        self.high = np.array([self.projected[a:b].max(axis=0) for a, b in zip(self.at, self.at[1:], strict=False)])

    def search(self, queries: np.ndarray, projected: np.ndarray, unit: float, bound: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k nearest of each query that the stopping test lets be verified.

        queries have norm `unit`; bound: squared distance of the k-th nearest known so far, or inf. Leaves come in
        order of projected distance, a few more each time; a query ends when the next leaf's projected
        distance is over stop x its k-th squared distance.
        """
        q, n = len(queries), len(self.ids)
        scores = np.full((q, n), -np.inf)
        gap = box_distance(projected, self.low, self.high)
        near = np.argsort(gap, axis=1, kind="stable")
        bound, live, done = bound.copy(), np.arange(q), 0
        for upto in [2, 6, 16, 40, 100, 10**9]:
            upto = min(upto, near.shape[1])
            asked = near[live, done:upto]
            who, which = np.nonzero(np.take_along_axis(gap[live], asked, 1) <= stop * bound[live, None])
            leaf, query = asked[who, which], live[who]
            order = np.argsort(leaf, kind="stable")
            leaf, query = leaf[order], query[order]
            for a, b in zip(begin := np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else [], [*begin[1:], len(leaf)], strict=True):
                lo, hi = self.at[leaf[a]], self.at[leaf[a] + 1]
                scores[query[a:b], lo:hi] = queries[query[a:b]] @ self.vectors[lo:hi].T
            if n >= k:
                kth = np.partition(scores[live], n - k, axis=1)[:, n - k]
                bound[live] = np.minimum(bound[live], np.where(np.isfinite(kth), 2 * unit * unit - 2 * kth, np.inf))
            done = upto
            if done == near.shape[1]:
                break
            live = live[np.take_along_axis(gap[live], near[live, done, None], 1)[:, 0] <= stop * bound[live]]
            if not len(live):
                break
        least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(q, -np.inf)
        slack = 1e-9 * unit * unit
        who, row = np.nonzero(np.isfinite(scores) & (scores >= least[:, None] - slack))
        return who, row, scores[who, row]


def component(*tables: DataFrame) -> str:
    """What vectors are kept as: float where all are, else double."""
    return "float" if all(t.schema["embedding"].dataType.elementType == T.FloatType() for t in tables) else "double"


def clean(embeddings: DataFrame, kind: str) -> DataFrame:
    """vec_id, vector, norm of the rows that take part: finite in every component and in norm, and not zero."""
    v = F.col("embedding")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(f"array<{kind}>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    return rows.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).filter((F.col("norm") > 0) & (F.col("norm") < F.lit(float("inf"))))


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k rows of embeddings (vec_id, embedding) with the largest inner product with each query (the same columns).

    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A query's own vec_id is no
    candidate; a vec_id stands once in a result, with its best score where rows repeat it; of rows that repeat a query's
    vec_id the least vector asks. All candidates are returned where there are fewer than k. Null, zero and
    non-finite vectors and null ids take no part, on either side; of vectors of different lengths the shorter has zeros
    at its end; empty tables give no rows; other columns are not looked at.

    Inner products become distances: rows get a component that brings all to the largest norm, queries
    are scaled to it. Cells cut the projected space; a query first looks into its own cell, and then into
    the cells that the stopping test, at the distance found there, does not rule out. Cells grow in number with the rows,
    and a block of queries meets only the cells that its queries look into.
    """
    spark = embeddings.sparkSession
    kind = component(embeddings, queries)
    rows, asked = clean(embeddings, kind), clean(queries, kind)
    stats = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("vector"))).first()
    if not stats[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, largest, dim = stats
    padded = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.slice(F.concat("vector", F.array_repeat(F.lit(0.0).cast(kind), dim)), 1, dim))
    rows, asked = rows.withColumn("vector", padded), asked.filter(F.size("vector") <= dim).withColumn("vector", padded)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("vector", "norm")).alias("v")).select("vec_id", "v.*")
    table = projection(dim)

    def project(vectors: np.ndarray, norms: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return (vectors * (largest / norms)[:, None]) @ table[:-1]
        return vectors @ table[:-1] + np.sqrt(np.maximum(largest**2 - norms**2, 0))[:, None] * table[-1]

    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector", "norm").toArrow().combine_chunks()
    drawn = project(_matrix(some["vector"].chunk(0), dim), some["norm"].to_numpy(), False)
    n_cells = max(1, min(total // PART, len(drawn) // LEAST))
    cells = Cells(split(drawn, max(1, -(-len(drawn) // n_cells)))[1])
    stop = chi2_quantile(SURE, DIMS)

    def index(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    p = project(_matrix(b.column(1), dim), b.column(2).to_numpy(), query)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), DIMS).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(1), b.column(2)], ["vec_id", "projected", "vector", "norm"])

        return run

    def homes(table: DataFrame, *columns: str) -> DataFrame:
        """table with `cell`."""
        shared = spark.sparkContext.broadcast(cells)  # a few numbers for each 8192 rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = shared.value.home(_matrix(b.column(b.schema.get_field_index("projected")), DIMS))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *b.columns], ["cell", *b.schema.names])

        fields = [f for f in table.select(*columns).schema]
        return table.select(*columns).mapInArrow(tidy(run), T.StructType([T.StructField("cell", T.IntegerType()), *fields]))

    indexed = materialize(rows.mapInArrow(tidy(index(False)), _INDEX.format(kind)), "vectors")
    asked = materialize(asked.select("vec_id", "vector", "norm").mapInArrow(tidy(index(True)), _INDEX.format(kind)), "queries")
    counts = homes(indexed, "vec_id", "projected").groupBy("cell").count().filter(F.col("count") > 2 * PART)
    large = spark.createDataFrame(counts.collect(), "cell int, count long")  # SAMPLE / LEAST rows at most
    if large.limit(1).count():

        def fit(key: tuple, rows: pa.Table) -> pa.Table:
            points = _matrix(rows.combine_chunks()["projected"].chunk(0), DIMS)
            n = max(1, min(rows["count"][0].as_py() // PART, len(points) // LEAST))
            tree = split(points, max(1, -(-len(points) // n)))[1]
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([[-1 if x is None else x[0] for x in tree]], pa.list_(pa.int32())), "cuts": pa.array([[0.0 if x is None else x[1] for x in tree]], pa.list_(pa.float64()))})

        share = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(5)), 11) / F.lit(float(1 << 53))
        drawn_rows = homes(indexed, "vec_id", "projected").join(large, "cell").filter(share * F.col("count") < CELL_SAMPLE)
        trees = drawn_rows.select("cell", "count", "projected").groupBy("cell").applyInArrow(fit, "cell int, dims array<int>, cuts array<double>").collect()
        cells = cells.refined({r["cell"]: [None if d < 0 else (d, v) for d, v in zip(r["dims"], r["cuts"], strict=True)] for r in trees})

    sizes = homes(indexed, "vec_id", "projected").groupBy("cell").count()
    parts = materialize(sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("count") / (2 * PART))).cast("int").alias("parts")), "parts")
    placed = homes(indexed, "vec_id", "projected", "vector").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries (left) of one block in one part (right)."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        part = Part(right["vec_id"].to_numpy(), _matrix(right["vector"].chunk(0), dim), _matrix(right["projected"].chunk(0), DIMS), k + 1)
        q, norms, p, bound = _matrix(left["vector"].chunk(0), dim), left["norm"].to_numpy(), _matrix(left["projected"].chunk(0), DIMS), left["bound"].to_numpy()
        scaled = q * (largest / norms)[:, None]
        who, row = [], []
        for i in range(0, len(q), 256):
            a, r, _ = part.search(scaled[i : i + 256], p[i : i + 256], largest, bound[i : i + 256], k + 1, stop)
            who.append(a + i)
            row.append(r)
        who, row = np.concatenate(who), np.concatenate(row)
        score = np.add.reduce(q[who] * part.vectors[row], axis=1)  # the same order of sums for each pair
        return pa.table({"query_id": left["vec_id"].to_numpy()[who], "vec_id": part.ids[row], "score": score})

    def visit(targets: DataFrame) -> DataFrame:
        """targets: queries with cell and bound. A cell's queries are dealt over as many blocks as they fill."""
        blocks = targets.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = targets.join(blocks, "cell").join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "block", "vec_id", "vector", "projected", "norm", "bound")
        data = placed.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "part", "block", "vec_id", "vector", "projected")
        by = ["cell", "part", "block"]
        return dealt.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(look, _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found, n: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    own = homes(asked, "vec_id", "projected", "vector", "norm")
    first = materialize(top(visit(own.withColumn("bound", F.lit(float("inf")))), k + 1), "nearest")
    kth = first.filter(F.col("rank") == k + 1).select(F.col("query_id").alias("vec_id"), "score")
    bound = F.coalesce(2 * largest * largest - 2 * F.col("score") * largest / F.col("norm"), F.lit(float("inf")))
    bounded = asked.join(kth, "vec_id", "left").withColumn("bound", bound).select("vec_id", "projected", "vector", "norm", "bound")
    shared = spark.sparkContext.broadcast(cells)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                p, bound = _matrix(c.column(1), DIMS), c.column(4).to_numpy()
                who, cell = shared.value.within(p, stop * bound)
                away = cell != shared.value.home(p)[who]
                who, cell = pa.array(who[away]), cell[away]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(x.take(who) for x in c.columns)], ["cell", *c.schema.names])

    others = visit(materialize(bounded.mapInArrow(tidy(reach), f"cell int, {_INDEX.format(kind)}, bound double"), "reach"))
    found = first.select("query_id", "vec_id", "score").union(others).filter("query_id <> vec_id")
    return top(found, k).select("query_id", "rank", "vec_id", "score")


def op2_srs_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.pmod("vec_id", F.lit(20)) == 0), 20)


QUERIES = {"op2_srs_neighbours": op2_srs_neighbours}
ORACLE_SQL: dict[str, str] = {}
