"""The operators' tables, rendered from the driver's: each has its twin in sql_tables()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Neutral markers for texts that are invented prose.
UP, DOWN = ("ing ", "en der"), ("eux ", "tion,")
TOPICS = (("endings", "tion|ment"), ("sharp", "ß"), ("numbers", "[0-9]{3}"), ("accent", "é|è"), ("plural", "os |as "))
STOP = ("thation", "ouement")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit for each document and its language's query: query_id is the language, rank by a hash of the id."""
    d = documents(spark, sf_dir)
    return d.select(F.col("lang").alias("query_id"), "doc_id", F.lit(0).alias("chunk_index"), "text", ((F.col("doc_id") * 7919) % 1000 / 1000.0).alias("score"), F.col("doc_id").alias("rank"), "source")


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a hypothesis, its customer's nation of 25 is the run (o_custkey % 25)."""
    o = table(spark, sf_dir, "orders")
    n = lambda k: ((F.col("o_orderkey") * k) % 11).cast("double")
    text = F.concat(
        F.lit("Increase recovery by "), (F.col("o_orderkey") % 19).cast("string"), F.lit(" % at pH "), (F.col("o_orderkey") % 14).cast("string"), F.lit("-"), (F.col("o_orderkey") % 14 + 2).cast("string"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(", pH 9.5 in process mode")).otherwise(F.lit("")), F.lit(" for "), F.col("o_orderpriority"),
    )
    return o.select(
        F.col("o_orderkey").alias("hyp_id"), (F.col("o_custkey") % 25).cast("string").alias("run_id"), text.alias("text"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("short")).otherwise(F.concat(F.lit("mechanism of "), "o_orderpriority")).alias("mechanism"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("none")).otherwise(F.lit("согласно источникам типичный режим даёт меньший результат")).alias("reasoning"),
        n(3).alias("novelty"), n(5).alias("feasibility"), n(7).alias("expected_value"), n(2).alias("risk_technical"), n(4).alias("risk_economic"),
        F.when(F.col("o_orderkey") % 6 == 0, F.array().cast("array<struct<doc_id:string,snippet:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("doc_id"), F.concat(F.lit("snippet of order "), F.col("o_orderkey").cast("string")).alias("snippet")))).alias("sources"),
        F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("контроль"))).otherwise(F.array(F.lit("Лабораторная проверка 14 дней: проба 1 кг"), F.lit("Пилот 3 недели; успех - рост 3%"), F.lit("внедрение"))).alias("roadmap"),
    )


HYPOTHESES = """hyp AS (SELECT o_orderkey AS hyp_id, CAST(o_custkey % 25 AS VARCHAR) AS run_id,
 'Increase recovery by ' || CAST(o_orderkey % 19 AS VARCHAR) || ' % at pH ' || CAST(o_orderkey % 14 AS VARCHAR) || '-' || CAST(o_orderkey % 14 + 2 AS VARCHAR)
  || CASE WHEN o_orderkey % 3 = 0 THEN ', pH 9.5 in process mode' ELSE '' END || ' for ' || o_orderpriority AS text,
 CASE WHEN o_orderkey % 4 = 0 THEN 'short' ELSE 'mechanism of ' || o_orderpriority END AS mechanism,
 CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'согласно источникам типичный режим даёт меньший результат' END AS reasoning,
 CAST(o_orderkey * 3 % 11 AS DOUBLE) AS novelty, CAST(o_orderkey * 5 % 11 AS DOUBLE) AS feasibility, CAST(o_orderkey * 7 % 11 AS DOUBLE) AS expected_value,
 CAST(o_orderkey * 2 % 11 AS DOUBLE) AS risk_technical, CAST(o_orderkey * 4 % 11 AS DOUBLE) AS risk_economic,
 o_orderkey % 6 <> 0 AS has_source, 'd' || CAST(o_custkey AS VARCHAR) AS doc_id, 'snippet of order ' || CAST(o_orderkey AS VARCHAR) AS snippet,
 CASE WHEN o_orderkey % 7 = 0 THEN ['контроль'] ELSE ['Лабораторная проверка 14 дней: проба 1 кг', 'Пилот 3 недели; успех - рост 3%', 'внедрение'] END AS roadmap
 FROM orders)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels: a review of the hypothesis with the same number; others have none."""
    q = F.col("quality") * 8.0
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("hyp_id"), (q + 1).alias("testability"), q.alias("evidence_quality"), (q + 0.5).alias("relevance"), q.alias("novelty_assessment"), q.alias("kpi_link"), (F.col("toxic") == 0).alias("review_approved"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line is a step: its quantity in days; resources by flag and status."""
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy(F.col("l_orderkey").alias("hyp_id"), F.col("l_linenumber").alias("step_order")).agg(F.max(F.col("l_quantity").cast("int")).alias("duration_days"), F.min("l_returnflag").alias("r"), F.min("l_linestatus").alias("s"))
    return s.select("hyp_id", "step_order", F.concat(F.lit("step "), F.col("step_order").cast("string")).alias("title"), "duration_days", F.array("r", "s").alias("resources"), F.when(F.col("step_order") > 1, F.array(F.col("step_order") - 1)).otherwise(F.array().cast("array<int>")).alias("depends_on"))


STEPS = """st AS (SELECT l_orderkey AS hyp_id, l_linenumber AS step_order, max(CAST(trunc(l_quantity) AS INT)) AS duration_days, min(l_returnflag) AS r, min(l_linestatus) AS s FROM lineitem GROUP BY ALL)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as feedback: purchases confirm, errors reject, the rest needs review; scores from value."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "rejected").otherwise("needs_review")
    s = lambda k: F.when(F.col("event_id") % 9 != k, (F.col("event_id") * (k + 2) % 11).cast("double"))
    return e.select("event_id", "ts", (F.col("user_id") % 50).alias("tenant"), status.alias("status"), s(0).alias("novelty"), s(1).alias("feasibility"), s(2).alias("expected_value"), s(3).alias("risk"), F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" changes process")).alias("text"))


EVENTS = """ev AS (SELECT event_id, ts, user_id % 50 AS tenant, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' ELSE 'needs_review' END AS status,
 CASE WHEN event_id % 9 <> 0 THEN CAST(event_id * 2 % 11 AS DOUBLE) END AS novelty, CASE WHEN event_id % 9 <> 1 THEN CAST(event_id * 3 % 11 AS DOUBLE) END AS feasibility,
 CASE WHEN event_id % 9 <> 2 THEN CAST(event_id * 4 % 11 AS DOUBLE) END AS expected_value, CASE WHEN event_id % 9 <> 3 THEN CAST(event_id * 5 % 11 AS DOUBLE) END AS risk,
 event_type || ' of user ' || CAST(user_id AS VARCHAR) || ' changes process' AS text FROM events)"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of sheets, one for each brand; every 10th row is a size-class header, every 7th a size class, some carry KPI labels."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    label = F.when(k % 10 == 0, F.lit("Класс крупности")).when(k % 7 == 0, F.concat(F.lit("+"), F.col("p_size").cast("string"))).when(k % 11 == 0, F.lit("Итого")).when(k % 5 == 0, F.lit("Recovery, total")).otherwise(F.col("p_name"))
    cells = F.array(F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("row")), label, F.col("p_size").cast("string"), (k % 100).cast("string"), F.lit(""), F.lit(""))
    return p.select(F.lit("parts").alias("workbook"), F.col("p_brand").alias("sheet"), (k.cast("int")).alias("row_idx"), cells.alias("cells"))


SHEETS = """sh AS (SELECT 'parts' AS workbook, p_brand AS sheet, CAST(p_partkey AS INT) AS row_idx, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'row' END AS c0,
 CASE WHEN p_partkey % 10 = 0 THEN 'Класс крупности' WHEN p_partkey % 7 = 0 THEN '+' || CAST(p_size AS VARCHAR) WHEN p_partkey % 11 = 0 THEN 'Итого' WHEN p_partkey % 5 = 0 THEN 'Recovery, total' ELSE p_name END AS c1,
 CAST(p_size AS VARCHAR) AS c2, CAST(p_partkey % 100 AS VARCHAR) AS c3 FROM part)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, nations and parts as nodes (id, name, label); who supplies what, and where from, as edges."""
    s, n, p, li = (table(spark, sf_dir, t) for t in ("supplier", "nation", "part", "lineitem"))
    nodes = (
        s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("Process").alias("label"))
        .union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_name", F.lit("Publication")))
        .union(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), "p_name", F.lit("Material")))
    )
    edges = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.lit("SUPPLIES").alias("type")).distinct()
    return nodes, edges.union(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("FROM")))


GRAPH = """nd AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'Process' AS label FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name, 'Publication' FROM nation UNION ALL SELECT 'p' || p_partkey, p_name, 'Material' FROM part),
ed AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, 'SUPPLIES' AS type FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'FROM' FROM supplier)"""
