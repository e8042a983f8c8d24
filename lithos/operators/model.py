"""Ridge regression over experiment records by sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import text as tx

from .lineage import settled, spread
from .ranks import exact_median
from .retrieval import ranked

# Parts of metric names.
TARGETS = ("recovery", "yield", "strength", "efficiency", "quality", "result")
FEATURES = ("ph", "dosage", "temperature", "pressure", "concentration", "time", "dose", "temp", "concentr")
DEFAULTS = {"ph": 7.0, "dosage": 0.3, "temperature": 25.0, "pressure": 0.1}


def metric_key(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9_]", "_"), "^_+|_+$", "")


def feature_records(metrics: DataFrame) -> DataFrame:
    """Long records (doc_id, key, role, value) of metrics (doc_id, at, key, value, and bucket where known): the first
    target and up to five features of each document that has both. Where no key names a target, the first of the bucket
    measurement_results is one."""
    m = metrics.withColumns({"key": metric_key(F.col("key")), "value": tx.parse_number(F.col("value").cast("string"))}).filter("doc_id IS NOT NULL AND value IS NOT NULL")
    role = F.when(tx.contains_any(F.col("key"), TARGETS), "target").when(tx.contains_any(F.col("key"), FEATURES), "feature")
    m, spares = m.withColumn("role", role), "bucket" in metrics.columns
    if not spares:
        m = m.filter("role IS NOT NULL")
    # metrics are dealt out by document once, and sorted twice
    own = Window.partitionBy("doc_id").orderBy("key", F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has = lambda name: F.coalesce(F.max(F.col("role") == name).over(own), F.lit(False))
    m = spread(m, "doc_id").withColumns({"__target": has("target"), "__feature": has("feature")})
    if not spares:
        m = m.filter("__target AND __feature")
    last = ranked(m, ["doc_id", "key"], [F.desc("at")], 1, "n").drop("n")
    whole = Window.partitionBy("doc_id")
    if spares:
        spare = F.when(~F.col("__target") & (F.col("bucket") == "measurement_results"), F.struct("at", "key"))
        last = last.withColumn("role", F.when(F.col("key").isNotNull() & (spare == F.min(spare).over(whole)), F.lit("target")).otherwise(F.col("role")))
    r = ranked(last.filter("role IS NOT NULL"), ["doc_id", "role"], [F.asc("at")], 5, "n").filter("role = 'feature' OR n = 1").drop("n", "__target", "__feature")
    if spares:
        both = lambda name: F.max(F.col("role") == name).over(whole)
        r = r.withColumn("__both", both("target") & both("feature")).filter("__both").drop("__both")
    return r.select("doc_id", *[c for c in r.columns if c != "doc_id"])


def design(records: DataFrame, most: int = 5, spare: int = 3) -> DataFrame:
    """(kind, key, n) of the columns of the design matrix: the commonest target, and the features seen twice or
    more, the first five; else the three commonest. Ties go by key."""
    counts = settled(records.groupBy("role", "key").agg(F.count("*").alias("n")))  # a row a key, read three times
    target = counts.filter("role = 'target'").orderBy(F.desc("n"), "key").limit(1)
    common = counts.filter("role = 'feature' AND n >= 2").orderBy("key").limit(most)
    top = counts.filter("role = 'feature'").orderBy(F.desc("n"), "key").limit(spare)
    chosen = common if common.limit(1).count() else top
    return target.union(chosen)


def ridge(df: DataFrame, target: str, features: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """One row (target, features, n, baseline, r2, intercept, coefficients, means, scales).

    Features are scaled by their population deviation. One pass gives means and centred co-moments, which Spark merges
    without the cancelling of plain sums; the solve is as small as the number of features; R2 follows from the same
    moments. The median is selected (ranks.exact_median()). Fewer than 4 complete rows give no row.
    """
    spark, cols = df.sparkSession, [*features, target]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    moments = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)] + [F.covar_pop(a, b).alias(f"p_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    got = rows.agg(F.count("*").alias("n"), *moments).first()
    schema = "target string, features array<string>, n long, baseline double, r2 double, intercept double, coefficients array<double>, means array<double>, scales array<double>"
    if not got or got["n"] < 4:
        return spark.createDataFrame([], schema)
    n, k = got["n"], len(features)
    mean = np.array([got[f"m_{i}"] for i in range(k + 1)])
    cov = np.array([[got[f"p_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    scale[scale == 0] = 1.0
    xx, xy = cov[:k, :k] / np.outer(scale, scale), cov[:k, k] / scale
    w = np.linalg.solve(n * xx + alpha * np.eye(k), n * xy)
    left = cov[k, k] - 2 * w @ xy + w @ xx @ w
    r2 = 1 - left / cov[k, k] if cov[k, k] > 0 else 0.0
    return spark.createDataFrame([(target, list(features), n, exact_median(rows, target), float(r2), float(mean[k]), w.tolist(), mean[:k].tolist(), scale.tolist())], schema)


def text_features(text: Column, features: Sequence[str], defaults: dict[str, float] = DEFAULTS) -> Column:
    """The features that a text states, over defaults, as an array."""
    stated = F.transform_keys(tx.parameters(text), lambda k, v: F.lower(k))
    return F.array(*[F.coalesce(F.try_element_at(stated, F.lit(f.lower())), F.lit(float(defaults.get(f.lower(), 1.0)))) for f in features])


def predict(df: DataFrame, model: DataFrame, values: Column) -> DataFrame:
    """Predicted, delta (to the median) and predictive score of df; without a model null and 0.45."""
    joined = df.join(F.broadcast(model), F.lit(True), "left")
    scaled = F.zip_with(F.zip_with(values, "means", lambda x, m: x - m), "scales", lambda x, s: x / s)
    p = F.col("intercept") + F.aggregate(F.zip_with(scaled, "coefficients", lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    clamp = lambda c: F.greatest(F.lit(0.05), F.least(F.lit(0.95), c))
    out = joined.withColumn("predicted", p).withColumn("delta", F.col("predicted") - F.col("baseline"))
    score = clamp(clamp(0.5 + F.col("delta") / 20) * (0.5 + 0.5 * F.greatest(F.lit(0.0), F.col("r2"))))
    return out.withColumn("predictive", F.when(F.col("delta").isNotNull(), score).otherwise(F.lit(0.45))).select(*df.columns, "predicted", "delta", "predictive")


def prediction_notes(df: DataFrame, model: DataFrame, values: Column, base: Column, kpi: Column) -> DataFrame:
    """L05 in words: df with `patterns` and `notes`. values: the features (L04), base: those of the ordinary regime, kpi: the label."""
    number = lambda c: F.format_string("%.2f", c)
    own, plain = (predict(df.withColumn("__v", v), model, F.col("__v")) for v in (values, base))
    key = [c for c in df.columns]
    both = own.withColumn("__row", F.to_json(F.struct(*key))).join(plain.select(F.to_json(F.struct(*key)).alias("__row"), F.col("predicted").alias("__base")).distinct(), "__row", "left").drop("__row")
    both = both.join(F.broadcast(model.select("baseline", "r2", F.col("n").alias("__n"), F.col("target").alias("__target"))), F.lit(True), "left")  # one row
    known = F.col("predicted").isNotNull()
    patterns = F.array(
        F.concat(F.lit("Прогноз "), kpi, F.lit(": "), number(F.col("predicted")), F.lit(" (гипотеза)")), F.concat(F.lit("Базовый режим: "), number(F.col("__base"))),
        F.concat(F.lit("Δ к медиане корпуса ("), number(F.col("baseline")), F.lit("): "), F.format_string("%+.2f", F.col("delta"))),
    )
    notes = F.concat(F.lit("Ridge R²="), number(F.col("r2")), F.lit(", n="), F.col("__n").cast("string"), F.lit(", target="), "__target", F.lit("; прогноз "), number(F.col("predicted")), F.lit(" vs база "), number(F.col("__base")))
    untrained = F.lit("ML-модель не обучена (мало исторических экспериментов)")
    return both.withColumns({"patterns": F.when(known, patterns).otherwise(F.array().cast("array<string>")), "notes": F.when(known, notes).otherwise(untrained)}).select(*key, "predicted", "delta", "predictive", "patterns", "notes")


def model_label(model: DataFrame) -> DataFrame:
    """L06."""
    return model.select(F.concat(F.lit("Ridge ("), "target", F.lit(" ~ "), F.array_join(F.slice("features", 1, 4), ", "), F.lit(")")).alias("label"), "r2", "baseline")
