"""Blocked top-k against testing every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.operators import retrieval, vectors


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((500, 12))
    x[200:350] = x[200]  # copies: ties go by id
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist(), "big" if i % 3 else f"g{i % 5}") for i in range(500)]
    rows += [(1000, None, "big"), (1001, [1.0, 2.0], "big"), (1002, [], "big")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, g string").repartition(3)
    return x, df, [row[2] for row in rows[:500]]


def want(x, i, among, k):
    s = {j: float((x[i] * x[j]).sum()) for j in among}
    return sorted(among, key=lambda j: (-s[j], j))[:k]


@pytest.mark.parametrize("sizes", [None, (64, 20, 16, 8, 8)])
def test_top_k(spark, data, monkeypatch, sizes):
    """As shipped, and with many blocks of rows and of queries."""
    x, df, groups = data
    if sizes:
        for name, n in zip(("ROWS", "QUERIES", "ROWS_AT_ONCE", "QUERIES_AT_ONCE", "FEW"), sizes, strict=True):
            monkeypatch.setattr(vectors, name, n)
    asked = df.filter("vec_id % 7 = 0 OR vec_id >= 1000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "g")
    for k in (1, 5, 600):
        got = {}
        for r in retrieval.vector_top_k(df, asked.drop("g"), k, exclude_self=True).filter("query_id < 1000").orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == {i: want(x, i, [j for j in range(500) if j != i], k) for i in range(0, 500, 7)}
    plan = retrieval.vector_top_k(df, asked.drop("g"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in retrieval.vector_top_k_in(df, asked, 4, "g").filter("query_id < 1000").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {i: want(x, i, [j for j in range(500) if groups[j] == groups[i]], 4) for i in range(0, 500, 7)}
    assert retrieval.vector_top_k(df.limit(0), asked.drop("g"), 5).count() == 0 and retrieval.vector_top_k(df, asked.drop("g").limit(0), 5).count() == 0
