"""Places and middles of large groups, which no task holds whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

#: So many values at most come to the driver at the end of exact_median().
FEW = 10_000
CUTS = 1_024
#: So many beginnings of groups in partitions at most go to every task.
STARTS = 100_000


def ranked_wide(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """A row's place (from 1) among those that share `by`, as retrieval.ranked(), for groups that may be large.

    Rows are range-sorted by group and order, so that a large group lies in several partitions; a row's place is its distance from where its
    group begins in its partition, and the number of the group's rows in the partitions before. Columns that begin with __ are this function's.
    """
    by = list(by)
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    placed = settled(placed.withColumn("__part", F.shiftright("__at", 33)))
    starts = placed.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("__at").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settled(starts.select(F.col("__part").alias("__p"), (before - F.col("__first") + 1).alias("__shift"), *[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)]))
    if starts.count() <= STARTS:  # rows are not dealt out again
        starts = F.broadcast(starts)
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{i}"))
    return placed.join(starts, same).select(*[c for c in df.columns if c != name], (F.col("__at") + F.col("__shift")).cast("int").alias(name))


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column of doubles (the mean of the two in the middle), without a sort or a buffer of all values.

    Each pass counts the values between CUTS cuts, and goes on between the two cuts that hold the middle; some passes leave FEW values, or
    one. Nulls and NaN do not count.
    """
    v = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    return (_selected(v, (n - 1) // 2, n, low, high) + _selected(v, n // 2, n, low, high)) / 2


def _selected(v: DataFrame, k: int, n: int, low: float, high: float) -> float:
    """The value that k others come before."""
    while n > FEW and low < high:
        step = high / CUTS - low / CUTS
        cell = F.least(F.greatest(F.floor((F.col("v") - low) / step) if step > 0 else F.lit(0), F.lit(0)), F.lit(CUTS - 1)).cast("int")
        rows = v.filter(F.col("v").between(low, high)).groupBy(cell.alias("cell")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # CUTS rows at most
        for r in sorted(rows, key=lambda r: r["low"]):
            if k < r["n"]:
                if (r["low"], r["high"]) == (low, high):
                    return _counted(v, k, low, high)
                n, low, high = r["n"], r["low"], r["high"]
                break
            k -= r["n"]
    if low == high:
        return low
    return sorted(r["v"] for r in v.filter(F.col("v").between(low, high)).collect())[k]


def _counted(v: DataFrame, k: int, low: float, high: float) -> float:
    """The same where cuts no longer part the values: neighbouring doubles, which are few but for their repeats."""
    for r in sorted(v.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("v").alias("n")).collect()):
        if k < r["n"]:
            return r["v"]
        k -= r["n"]
    raise ValueError("no such place")
