"""Mixing sources to target weights as a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, parquet, rank_distinct

WEIGHTS = (1, 2, 3)
#: How often a document may be taken at most; a source's target stops at so many times its size.
MOST = 3
#: Weight over training time as (time, factor) knots, joined by lines; one for each of WEIGHTS. Only the shape counts.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size; a row for each source) with `weight` and `target`.

    Sources by code point, null last, weigh weights[0], weights[1], ... in turn. The targets share the
    sum of all sizes by weight; a target stops at most x its source's size, and the excess is shared
    again by weight until none is above.
    """
    ranked = rank_distinct(sizes, source)
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(weight, (F.col("__rank") % len(weights) + 1).cast("int"))).drop("__rank")
    limit = F.col("source_size") * F.lit(most)
    level, full = None, -1
    while True:  # each turn fills one source more at least, and two or three turns are usual; only sums reach the driver
        above = F.lit(False) if level is None else limit < F.col("weight") * F.lit(level)
        r = ranked.agg(
            F.sum("source_size"), F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0)), F.count_if(above)
        ).first()
        if r[3] == full or not r[2]:
            break
        full = r[3]
        level = ((r[0] or 0) - (r[1] or 0)) / r[2]
    share = F.col("weight") * F.lit(float(level or 0.0))
    return ranked.withColumn("target", F.least(limit.cast("double"), share))


def at_demand(fraction: Column, schedule: tuple) -> Column:
    """The training time by which a source has had `fraction` (0 to 1) of its demand.

    The schedule is integrated line by line; within a line the integral is a parabola, solved for time.
    """
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False)]
    total, done, out = sum(areas), 0.0, None
    cases = []
    for ((t0, a), (t1, b)), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        need = F.greatest(fraction * total - F.lit(done), F.lit(0.0))
        slope = (b - a) / (t1 - t0)
        time = need / a if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * need, F.lit(0.0))) - a) / slope
        done += area
        cases.append((done / total, F.lit(t0) + F.least(time, F.lit(t1 - t0))))
    for upto, time in reversed(cases):
        out = time if out is None else F.when(fraction <= upto, time).otherwise(out)
    return out


def mix(df: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: tuple = WEIGHTS, most: int = MOST, schedules: tuple = SCHEDULES, seed: str = "mix") -> DataFrame:
    """df's rows with source_size, target, taken (words that the mix takes) and positions (training times).

    Within its source a document stands at a place given by the MD5 of its key; its words fill a span
    of the source's demand, once for each pass. A pass takes the document if the span's middle is
    below the target, so that whole documents are taken and a source misses its target by half a
    document at most. Its position is the time at which the source's weight schedule, integrated,
    reaches that middle. Reruns agree.

    Null sources form a source of their own; null keys share a place, as repeated rows do, and follow
    one another there; sizes of 0 (empty and null texts) take nothing; an empty df gives no rows.
    Columns of df named source_size, target, taken or positions are replaced.
    """
    keep = [c for c in df.columns if c not in ("source_size", "target", "taken", "positions")]
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("__place")
    rows = df.select(*[F.col(f"`{c}`") for c in keep], place).withColumn("__bucket", F.substring("__place", 1, 3))
    buckets = materialize(rows.groupBy(source, "__bucket").agg(F.sum(size).alias("__n")), "buckets")  # 4096 rows for a source at most
    sizes = buckets.groupBy(source).agg(F.sum("__n").alias("source_size"))
    goals = targets(sizes, source, weights, most).withColumnRenamed(source, "__source")
    ordered = Window.partitionBy(source).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("__before", F.coalesce(F.sum("__n").over(ordered), F.lit(0)))
    offsets = offsets.join(goals, F.col(source).eqNullSafe(F.col("__source"))).select("__source", F.col("__bucket").alias("__b"), "__before", "source_size", "weight", "target")
    inside = Window.partitionBy(source, "__bucket").orderBy("__place", key, size).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.withColumn("__in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(offsets, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b")))
    middle = F.col("__before") + F.col("__in") + F.col(size) / F.lit(2.0)
    passes = F.when(F.col("source_size") > 0, F.greatest(F.lit(0), F.least(F.lit(most), F.ceil((F.col("target") - middle) / F.col("source_size"))))).otherwise(F.lit(0)).cast("int")
    spans = spans.withColumns({"__middle": middle, "__passes": passes})

    def when(e: Column) -> Column:
        q = F.least((e * F.col("source_size") + F.col("__middle")) / F.col("target"), F.lit(1.0))
        out = at_demand(q, schedules[-1])
        for w, s in list(zip(weights, schedules, strict=True))[-2::-1]:
            out = F.when(F.col("weight") == float(w), at_demand(q, s)).otherwise(out)
        return out

    positions = F.transform(F.when(F.col("__passes") > 0, F.sequence(F.lit(0), F.col("__passes") - 1)).otherwise(F.array().cast("array<int>")), when)
    return spans.withColumns({"taken": (F.col("__passes") * F.col(size)).cast("long"), "positions": positions}).select(*[F.col(f"`{c}`") for c in keep], "source_size", "target", "taken", "positions")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each time a document is taken, range-sorted by training position."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position")


def op3_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, range-sorted by the training position at which the mix first takes them; the others follow in
    the order of a hash, so that no range is theirs alone."""
    docs = parquet(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")  # texts are read once
    mixed = mix(sized).withColumn("first_position", F.round(F.try_element_at("positions", F.lit(1)), 9))
    rest = 2 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    return mixed.orderBy(F.coalesce("first_position", rest)).select("doc_id", "size", "source_size", "target", "taken", "first_position")


QUERIES = {"op3_mix_curriculum": op3_mix_curriculum}

ORACLE_SQL = {
    "op3_mix_curriculum": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
r AS (SELECT *, 3 * source_size AS lim, 3 * source_size / weight AS ratio FROM w),
p AS (SELECT *, coalesce(sum(lim) OVER f, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weight_left, sum(source_size) OVER () AS total
      FROM r WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - full_before) / weight_left, ratio) FILTER (WHERE (total - full_before) / weight_left <= ratio) AS level FROM p),
t AS (SELECT source, source_size, weight, least(CAST(lim AS DOUBLE), weight * coalesce(level, 0)) AS target FROM r, l),
o AS (SELECT d.*, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM d),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle FROM o),
m AS (SELECT doc_id, size, t.source_size, t.target, t.weight, least(middle / t.target, 1) AS q,
  CASE WHEN t.source_size > 0 THEN greatest(0, least(3, ceil((t.target - middle) / t.source_size))) ELSE 0 END AS passes
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(passes * size AS BIGINT) AS taken,
  CASE WHEN passes > 0 THEN round(CASE WHEN weight = 1 THEN 1.5 - sqrt(greatest(2.25 - 2 * q, 0)) WHEN weight = 2 THEN q
    WHEN q <= 0.3125 THEN (sqrt(0.25 + q) - 0.5) / 0.5 ELSE 0.5 + least((sqrt(0.5625 + 5 * (q - 0.3125)) - 0.75) / 2.5, 0.5) END, 9) END AS first_position
FROM m
"""
}
