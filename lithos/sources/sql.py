"""Read-only SQL as a source, and stores of vectors, runs and exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.operators.retrieval import ranked

FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|attach|pragma|truncate|merge|grant)\b", re.IGNORECASE)


def checked(query: str) -> str:
    """The query, if it is one SELECT without words that change data; else ValueError."""
    bare = query.strip().rstrip(";").strip()
    if not bare.lower().startswith("select") or ";" in bare or FORBIDDEN.search(bare):
        raise ValueError("only a single SELECT is allowed")
    return bare


def sql_rows(spark: SparkSession, query: str, most: int = 500) -> DataFrame:
    return spark.sql(checked(query)).limit(most)


def jdbc_rows(spark: SparkSession, url: str, query: str, most: int = 500) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", checked(query)).load().limit(most)


def row_lines(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """(by, n, line): "Row n: k=v | …" without nulls."""
    cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in df.columns if c not in by]
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("n", n).select(*by, "n", F.concat(F.lit("Row "), F.col("n").cast("string"), F.lit(": "), F.concat_ws(" | ", *cells)).alias("line"))


def rows_document(df: DataFrame, title: str, order: list[str], by: list[str], most: int = 500) -> DataFrame:
    """(by, text): a group's first `most` rows as one document: title, columns, a line for each row (row_lines())."""
    names = [c for c in df.columns if c not in by]
    lines = row_lines(df, order, by).filter(F.col("n") <= most).groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", "line")))["line"], "\n").alias("lines"))
    return lines.select(*by, F.concat(F.lit(f"# {title}\n## Columns: {', '.join(names)}\n"), "lines").alias("text"))


def run_list(table: DataFrame) -> DataFrame:
    """The stored runs (run_id, hyp_id, approved, created_at): hypotheses, approvals and when, the newest first."""
    return table.groupBy("run_id").agg(F.count("*").alias("hypotheses"), F.count_if("approved").alias("approved"), F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "run_id")


def stored(table: DataFrame, run_id: str | None = None, hyp_id: str | None = None) -> DataFrame:
    """The rows of a run, or one hypothesis, of a stored table; the filter reaches the files."""
    out = table if run_id is None else table.filter(F.col("run_id") == run_id)
    return out if hyp_id is None else out.filter(F.col("hyp_id") == hyp_id)


def last_values(df: DataFrame, by: str, order: str, columns: list[str], head: int = 20) -> DataFrame:
    """Per group the last non-null value of each column over the first rows."""
    first = ranked(df, [by], [F.asc(order)], head, "n")
    return first.groupBy(by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c) for c in columns])


def point_key(doc_id, chunk_index):
    """The UUID5 (URL namespace) of `doc_id:chunk_index`, as text."""
    name = F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(F.concat_ws(":", doc_id.cast("string"), chunk_index.cast("string")), "UTF-8"))
    h = F.substring(F.sha1(name), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def upsert(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key."""
    return ranked(rows, key, [F.desc(version)], 1, "__n").drop("__n")


def replace_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Table with the rows of new in place of those that share their key."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def task_json(hyps: DataFrame) -> DataFrame:
    """One JSON document a hypothesis: summary of at most 120 characters, description, labels, custom fields, and nested
    what hyps has of roadmap, sources, business_case and predictive (its analysis)."""
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("")))
    description = F.concat_ws("\n\n", line("Механизм: ", "mechanism"), line("Обоснование: ", "reasoning"), line("Score: ", "composite")) if {"mechanism", "reasoning"} <= set(hyps.columns) else None
    fields = [c for c in ("composite", "approved", "novelty", "feasibility", "expected_value", "risk_technical", "risk_economic") if c in hyps.columns]
    nested = [c for c in ("roadmap", "sources", "business_case", "predictive") if c in hyps.columns]
    body = [F.substring("text", 1, 120).alias("summary"), F.array(F.lit("hypothesis"), F.col("run_id")).alias("labels"), F.struct(*fields).alias("custom_fields"), *nested]
    if description is not None:
        body.insert(1, description.alias("description"))
    return hyps.select("hyp_id", F.to_json(F.struct(*body)).alias("task"))


def task_rows(hyps: DataFrame) -> DataFrame:
    """The columns of the task list; sources joined by "; "."""
    return hyps.select("hyp_id", "run_id", F.substring("text", 1, 120).alias("summary"), "mechanism", "novelty", "feasibility", "expected_value", "composite", "approved", F.array_join(F.transform("sources", lambda s: s["doc_id"]), "; ").alias("sources"))
