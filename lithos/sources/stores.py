"""Keyed tables in files that a batch changes only where its keys are.

A table is partitioned by a column: a hash bucket of the key (S06, S17), or the run (S22). A change reads the partitions
that it touches, writes what they shall hold to a folder beside the table, and then puts them in their place by dynamic
partition overwrite. A change that was broken off is taken up again by the next one, from that folder. A table that only grows (X01) is partitioned by bucket and batch: a batch writes its own partitions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lithos.operators.lineage import spread

BUCKETS = 64
#: Rows in a file at most.
ROWS = 1_000_000
#: Rows of a bucket that one task is given, about.
PIECE = 16_384


def bucket_of(key: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, folder)
    return files.exists(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def _pending(folder: str) -> str:
    return f"{folder.rstrip('/')}_pending"


def read(spark: SparkSession, folder: str, part: str, kind: str = "string") -> DataFrame:
    """The table; the partition column is read as `kind`, whatever its values look like."""
    found = spark.read.parquet(folder).schema
    partition = StructField(part, spark.createDataFrame([], f"x {kind}").schema["x"].dataType)
    return spark.read.schema(StructType([f for f in found if f.name != part] + [partition])).parquet(folder)


def recover(spark: SparkSession, folder: str, part: str, kind: str = "string") -> None:
    """Ends a change that was broken off: if what it wrote is whole it is put in place, else it goes."""
    pending = _pending(folder)
    if exists(spark, f"{pending}/_SUCCESS"):
        whole = spark.read.parquet(pending)
        whole = whole.withColumn(part, F.col(part).cast(kind)).repartition(part)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS).partitionBy(part).parquet(folder)
    if exists(spark, pending):
        _delete(spark, pending)


def overwrite_parts(rows: DataFrame, folder: str, part: str, kind: str = "string") -> None:
    """Puts rows in the place of all that the table has in their partitions; the others stay as they are. rows may come
    from the table itself."""
    rows.write.mode("overwrite").parquet(_pending(folder))
    recover(rows.sparkSession, folder, part, kind)


def _touched(rows: DataFrame, part: str) -> list:
    """The values of a partition column: as many as there are partitions at most."""
    return [r[0] for r in rows.select(part).distinct().collect()]


# ---- tables by key (S06, S17, X01) ----------------------------------------------------------------


def upsert_store(rows: DataFrame, folder: str, key: Sequence[str], version: str, buckets: int = BUCKETS, by: Sequence[str] | None = None) -> None:
    """Rows into the table of that folder: of each key the newest version stays, of equal versions the new row.

    Keys lie in hash buckets (of `by`, a part of the key, where it is given); only the buckets of the batch's keys are read and written.
    A batch that comes again changes nothing. Null keys are keys. `bucket` may not be a column of rows.
    """
    spark = rows.sparkSession
    recover(spark, folder, "bucket", "int")
    new = rows.withColumn("bucket", bucket_of(by or key, buckets))
    touched = _touched(new, "bucket")
    if not touched:
        return
    both = new.withColumn("__new", F.lit(1))
    if exists(spark, folder):
        there = read(spark, folder, "bucket", "int").filter(F.col("bucket").isin(touched)).withColumn("__new", F.lit(0))
        both = both.unionByName(there, allowMissingColumns=True)
    names = [c for c in both.columns if c not in (*key, "bucket", "__new")]
    newest = both.groupBy("bucket", *key).agg(F.max_by(F.struct(*names), F.struct(version, "__new")).alias("r"))
    overwrite_parts(newest.select(*key, "r.*", "bucket"), folder, "bucket", "int")


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, key: Sequence[str], buckets: int = BUCKETS, by: Sequence[str] | None = None) -> DataFrame:
    """Rows of the table with the keys that `wanted` has; only their buckets are read."""
    asked = wanted.select(*key).distinct().withColumn("bucket", bucket_of(by or key, buckets))
    there = read(spark, folder, "bucket", "int").filter(F.col("bucket").isin(_touched(asked, "bucket")))
    return there.join(asked, ["bucket", *key], "left_semi").drop("bucket")


def add_new(rows: DataFrame, folder: str, key: Sequence[str], batch: str, make: Callable[[DataFrame], DataFrame] = lambda new: new, buckets: int = BUCKETS) -> None:
    """make(rows whose key no other batch brought) into a table by bucket of the key and batch, which only grows.

    Of rows with equal keys one comes in. Rows are dealt out once, beside the keys that their buckets have, and written once; what other
    batches wrote is neither read, but for its keys, nor written. A batch that is run again takes the place of what it wrote
    before. `bucket` and `batch` may not be columns of rows; make keeps the key and leaves `bucket` as it is.
    """
    spark = rows.sparkSession
    asked = rows.withColumn("bucket", bucket_of(key, buckets))
    held = asked.groupBy("bucket").count().collect()  # `buckets` rows at most
    if not held:
        return
    pieces = 1 + max(r["count"] for r in held) // PIECE
    both = asked.withColumn("__old", F.lit(0))
    if exists(spark, folder):
        schema = StructType([asked.schema[c] for c in (*key, "bucket")] + [StructField("batch", StringType())])
        there = spark.read.schema(schema).parquet(folder).filter(F.col("bucket").isin([r["bucket"] for r in held]) & (F.col("batch") != batch))
        both = both.unionByName(there.select("bucket", *key, F.lit(1).alias("__old")), allowMissingColumns=True)
    names = [c for c in rows.columns if c not in key]
    dealt = spread(both.withColumn("__piece", F.pmod(F.hash(*key), F.lit(pieces))), "bucket", "__piece")
    once = dealt.groupBy("bucket", "__piece", *key).agg(F.max("__old").alias("__old"), F.first(F.struct(F.lit(0), *names)).alias("r"))
    new = make(once.filter("__old = 0").select(*[F.col(f"r.{c}") if c in names else F.col(c) for c in rows.columns], "bucket"))
    new.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS).partitionBy("bucket", "batch").parquet(folder)


def new_keys(rows: DataFrame, folder: str, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows whose key the table does not have yet; only their buckets are looked at, and only the key is read."""
    spark = rows.sparkSession
    recover(spark, folder, "bucket", "int")
    if not exists(spark, folder):
        return rows
    asked = rows.withColumn("bucket", bucket_of(key, buckets))
    there = read(spark, folder, "bucket", "int").filter(F.col("bucket").isin(_touched(asked, "bucket"))).select("bucket", *key).distinct()
    return asked.join(there, ["bucket", *key], "left_anti").select(*rows.columns)


def point_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many points the collection has; 0 where it is not there yet."""
    if not exists(spark, folder):
        return spark.range(0).agg(F.count("id").alias("points"))
    return read(spark, folder, "bucket", "int").agg(F.count("bucket").alias("points"))


# ---- runs (S22) ------------------------------------------------------------------------------------


def save_runs(hyps: DataFrame, folder: str) -> None:
    """Writes whole runs (run_id, hyp_id, ...), each a partition; a run that is there already is written anew."""
    recover(hyps.sparkSession, folder, "run_id")
    overwrite_parts(hyps, folder, "run_id")


def load_run(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """One run; the other partitions are not listed among the files read."""
    return read(spark, folder, "run_id").filter(F.col("run_id") == run_id)


def load_hypothesis(spark: SparkSession, folder: str, hyp_id, run_id: str | None = None) -> DataFrame:
    """One hypothesis; of one run, if that is known."""
    return (read(spark, folder, "run_id") if run_id is None else load_run(spark, folder, run_id)).filter(F.col("hyp_id") == hyp_id)


def replace_hypotheses(new: DataFrame, folder: str) -> None:
    """Hypotheses (run_id, hyp_id, ...) in the place of those of their run and id; only their runs are read and written.
    What no run has does not come in. Columns that `new` lacks keep their values."""
    spark = new.sparkSession
    recover(spark, folder, "run_id")
    runs = _touched(new, "run_id")
    if not runs:
        return
    there = read(spark, folder, "run_id").filter(F.col("run_id").isin(runs))
    given = [c for c in new.columns if c not in ("run_id", "hyp_id")]
    n = new.select("run_id", "hyp_id", F.struct(*given).alias("__new"))
    both = there.join(n, ["run_id", "hyp_id"], "left")
    kept = {c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}").cast(there.schema[c].dataType)).otherwise(F.col(c)) for c in given}
    overwrite_parts(both.withColumns(kept).select(*there.columns), folder, "run_id")


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, hypotheses, approved, created_at), the newest first."""
    return read(spark, folder, "run_id").groupBy("run_id").agg(F.count("hyp_id").alias("hypotheses"), F.count_if("approved").alias("approved"), F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "run_id")
