"""Where long compositions cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and Spark runs in one process, a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return _own[0]


_own: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's name there."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept by checkpoint(): what reads it more than once does not compute it again, and lost
    executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as compressed columns: what reads a few of them does not read the others."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt out by key for work that is long for its bytes: a number of parts that is given is not merged into few by their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *key)
