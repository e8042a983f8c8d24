"""Exact nearest vectors by blocks: a block of rows meets a block of queries as one matrix product."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and queries of one; within a block, how many of either are multiplied at a time.
ROWS, QUERIES = 65_536, 8_192
ROWS_AT_ONCE, QUERIES_AT_ONCE = 2_048, 512
#: Rows of a block at least, where more blocks would only make more tasks.
FEW = 4_096
#: Products that may differ by rounding are computed again, each by itself.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(-1, width) if width else np.zeros((len(column), 0))


def nearest(rows: np.ndarray, queries: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k rows of largest product, equal ones by the row's number. skip: for each query the
    number of a row that takes no part (-1: none).

    The k-th best score so far is a query's bound: of the next rows only those count that reach it. What does is multiplied
    again pair by pair, so that equal vectors have equal scores wherever they stand.
    """
    length = np.linalg.norm(rows, axis=1).max(initial=0.0)
    found: list[tuple[np.ndarray, ...]] = []
    for q0 in range(0, len(queries), QUERIES_AT_ONCE):
        some = queries[q0 : q0 + QUERIES_AT_ONCE]
        n = len(some)
        slack = SLACK * length * np.linalg.norm(some, axis=1)
        bound = np.full(n, -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for r0 in range(0, len(rows), ROWS_AT_ONCE):
            scores = some @ rows[r0 : r0 + ROWS_AT_ONCE].T
            if skip is not None:
                own = skip[q0 : q0 + n] - r0
                inside = np.flatnonzero((own >= 0) & (own < scores.shape[1]))
                scores[inside, own[inside]] = -np.inf
            if scores.shape[1] >= k:
                bound = np.maximum(bound, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
            q, r = np.nonzero((scores >= (bound - slack)[:, None]) & (scores > -np.inf))
            exact = (some[q] * rows[r + r0]).sum(axis=1)
            q, r, exact = (np.concatenate(x) for x in zip(best, (q, r + r0, exact), strict=True))
            order = np.lexsort((r, -exact, q))
            q, r, exact = q[order], r[order], exact[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            best = (q[keep], r[keep], exact[keep])
            last = place == k - 1
            bound[q[last]] = np.maximum(bound[q[last]], exact[last])
        found.append((best[0] + q0, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # type: ignore[return-value]


def blocked_top_k(vectors: DataFrame, queries: DataFrame, k: int, within: Sequence[str] = (), exclude_self: bool = False) -> DataFrame:
    """(within, query_id, vec_id, score): of each block of vectors (vec_id, embedding) the k rows of largest product with each
    query (query_id, query_vector); what is best of all is among them. Sums are in double precision.

    Rows are dealt into blocks by a hash, those of a group (`within`: columns of both) among themselves, as many as
    the group's size asks for; queries likewise; each pair of blocks is one task's matrix product. Null vectors and vectors of another
    length than the query's take no part.
    """
    within = list(within)
    v = vectors.filter(F.col("embedding").isNotNull()).select(*within, "vec_id", F.col("embedding").alias("v"), F.size("embedding").alias("__width"))
    q = queries.filter(F.col("query_vector").isNotNull()).select(*within, "query_id", F.col("query_vector").alias("v"), F.size("query_vector").alias("__width"))
    group = [*within, "__width"]
    least = F.greatest(F.ceil(F.col("__rows") / F.lit(ROWS)), F.least(F.lit(vectors.sparkSession.sparkContext.defaultParallelism), F.ceil(F.col("__rows") / F.lit(FEW))))
    sizes = v.groupBy(*group).agg(F.count("vec_id").alias("__rows")).join(q.groupBy(*group).agg(F.count("query_id").alias("__asked")), group)
    sizes = sizes.select(*group, least.cast("int").alias("__vs"), F.ceil(F.col("__asked") / F.lit(QUERIES)).cast("int").alias("__qs"))

    def dealt(df: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        both = df.join(sizes, group)
        part = F.pmod(F.xxhash64(own), F.col(f"__{mine}"))
        copies = F.explode(F.sequence(F.lit(0), F.col(f"__{other}") - 1))
        return both.withColumn(f"__{mine[0]}", part.cast("int")).withColumn(f"__{other[0]}", copies).select(*group, "__v", "__q", own, "v")

    out = f"{''.join(f'{c} {v.schema[c].dataType.simpleString()}, ' for c in within)}query_id {q.schema['query_id'].dataType.simpleString()}, vec_id {v.schema['vec_id'].dataType.simpleString()}, score double"

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = [*within, "query_id", "vec_id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([*[(rows if rows.num_rows else asked).column(c).slice(0, 0) for c in within], asked.column("query_id").slice(0, 0), rows.column("vec_id").slice(0, 0), pa.array([], pa.float64())], names=names)
        rows = rows.take(pc.sort_indices(rows.column("vec_id")))  # a row's number then orders as its id
        width = asked.column("__width")[0].as_py()
        skip = None
        if exclude_self:
            skip = np.array(pc.fill_null(pc.index_in(asked.column("query_id"), rows.column("vec_id").combine_chunks()), -1).to_numpy(), np.int64)
        q, r, score = nearest(_matrix(rows.column("v"), width), _matrix(asked.column("v"), width), k, skip)
        return pa.Table.from_arrays([*[asked.column(c).take(q) for c in within], asked.column("query_id").take(q), rows.column("vec_id").take(r), pa.array(score)], names=names)

    left, right = dealt(v, "vec_id", "vs", "qs"), dealt(q, "query_id", "qs", "vs")
    right = right.withColumnsRenamed({"__v": "__rv", "__q": "__rq"} | {c: f"__r_{c}" for c in within}).withColumnRenamed("__width", "__rwidth")

    def renamed(rows: pa.Table, asked: pa.Table) -> pa.Table:
        plain = {f"__r_{c}": c for c in within} | {"__rwidth": "__width", "__rv": "__v", "__rq": "__q"}
        return meet(rows, asked.rename_columns([plain.get(c, c) for c in asked.column_names]))

    return left.groupBy(*group, "__v", "__q").cogroup(right.groupBy(*[f"__r_{c}" for c in within], "__rwidth", "__rv", "__rq")).applyInArrow(renamed, out)
