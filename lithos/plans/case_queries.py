"""Queries over cases: workbooks, checks, graphs, citations, feedback and whole proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx
from lithos.operators import business, citations, evaluation, feedback, graphs, hypotheses, judging, proposals, retrieval, tables
from lithos.sources import files
from lithos.sources import sql as stores

from . import record_queries as rec
from . import tables as t

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- workbooks -----------------------------------------------------------------------------------


def workbooks(spark: SparkSession, d: str) -> DataFrame:
    """An order is a workbook; its lines are rows of tailings, recoverable metal, size-class headers and size classes in turn."""
    w = t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").cast("int").cast("string").alias("q"))
    n, empty = F.col("n") % 4, F.lit("")
    cells = F.when(n == 1, F.array(F.lit("Отвальные хвосты"), "q", empty)).when(n == 2, F.array(F.lit("Итого извлекаемый металл"), F.concat("q", F.lit(",5")))).when(n == 3, F.array(F.lit("Класс крупности"), empty)).otherwise(F.array(F.concat(F.lit("+"), "q"), F.lit("10"), F.lit("2")))
    return w.select(F.concat(F.col("k").cast("string"), F.lit(".xlsx")).alias("workbook"), F.when(F.col("n") < 4, "a").otherwise("b").alias("sheet"), F.col("n").alias("row_idx"), cells.alias("cells"))


WORKBOOKS = """w AS (SELECT CAST(l_orderkey AS VARCHAR) || '.xlsx' AS workbook, l_linenumber AS n, CAST(CAST(trunc(max(l_quantity)) AS INT) AS VARCHAR) AS q FROM lineitem GROUP BY ALL),
i AS (SELECT *, last_value(CASE WHEN n % 4 = 3 THEN 1 END IGNORE NULLS) OVER (PARTITION BY workbook ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM w),
ln AS (SELECT workbook, -2 AS place, '- Итого извлекаемый металл в хвостах: ' || arg_max(q, n) || ',5%' AS line FROM w WHERE n % 4 = 2 GROUP BY 1
 UNION ALL SELECT workbook, -1, '- Отвальные хвосты: ' || arg_max(q, n) || ' т' FROM w WHERE n % 4 = 1 GROUP BY 1
 UNION ALL SELECT workbook, n, '- +' || q || ' мкм: доля класса 10%, метрика 2' FROM i WHERE n % 4 = 0 AND inside = 1)"""


@query(
    "k11_workbook_summary",
    "WITH " + WORKBOOKS + """, s AS (SELECT workbook, count(DISTINCT n < 4) AS sheets FROM w GROUP BY 1), k AS (SELECT DISTINCT workbook FROM ln)
SELECT workbook, '- Файл: ' || workbook || ', листов: ' || CAST(sheets AS VARCHAR) AS line FROM s
UNION ALL SELECT s.workbook, CASE WHEN k.workbook IS NULL THEN '## Обзор листов' ELSE '## Сводка KPI' END FROM s LEFT JOIN k USING (workbook) UNION ALL SELECT workbook, line FROM ln""",
)
def k11(spark: SparkSession, d: str) -> DataFrame:
    """The heads and KPI lines of all workbooks (sheets without KPIs: k11_overviews)."""
    return tables.workbook_summary(workbooks(spark, d)).filter("sheet = ''").select("workbook", "line")


@query(
    "k11_overviews",
    "WITH " + WORKBOOKS + """, k AS (SELECT DISTINCT workbook FROM ln), o AS (SELECT * FROM w WHERE workbook NOT IN (SELECT workbook FROM k))
SELECT workbook, CASE WHEN n < 4 THEN 'a' ELSE 'b' END AS sheet, '- Лист «' || CASE WHEN n < 4 THEN 'a' ELSE 'b' END || '»: ' || CAST(count(*) AS VARCHAR) || ' строк × ' || CAST(max(CASE WHEN n % 4 = 0 THEN 3 ELSE 1 END) AS VARCHAR) || ' колонок' AS line FROM o GROUP BY workbook, n < 4""",
)
def k11b(spark: SparkSession, d: str) -> DataFrame:
    return tables.workbook_summary(workbooks(spark, d)).filter("sheet <> '' AND at = 0").select("workbook", "sheet", "line")


@query(
    "k13_workbook_kpis",
    "WITH " + WORKBOOKS + """ SELECT workbook, (SELECT arg_max(q, n) FROM w x WHERE x.workbook = l.workbook AND n % 4 = 1) AS tailings_tonnage, (SELECT CAST(arg_max(q, n) AS DOUBLE) + 0.5 FROM w x WHERE x.workbook = l.workbook AND n % 4 = 2) AS recoverable_pct,
coalesce((SELECT string_agg('+' || q || ' мкм', ';' ORDER BY n) FROM i x WHERE x.workbook = l.workbook AND n % 4 = 0 AND inside = 1), '') AS sizes FROM (SELECT DISTINCT workbook FROM ln) l""",
)
def k13(spark: SparkSession, d: str) -> DataFrame:
    k = tables.workbook_kpis(tables.workbook_kpi_summary(workbooks(spark, d)))
    return k.select("workbook", "tailings_tonnage", "recoverable_pct", F.array_join("grain_classes", ";").alias("sizes"))


KPI_TEXT = "'# KPI-сводка: ' || workbook || chr(10) || 'Тег: enterprise_kpi — цитируй этот блок для KPI из Excel (%, тоннаж, крупность).' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY place)"


@query(
    "k14_priority_chunks",
    "WITH " + WORKBOOKS + ", p AS (SELECT workbook, " + KPI_TEXT + """ AS text FROM ln GROUP BY workbook)
SELECT workbook AS doc_id, CAST(0 AS INT) AS chunk_index, md5(text) AS digest FROM p UNION ALL SELECT w.workbook, CAST(n - 1 + CASE WHEN p.workbook IS NULL THEN 0 ELSE 1 END AS INT), md5(q) FROM w LEFT JOIN p USING (workbook)""",
)
def k14(spark: SparkSession, d: str) -> DataFrame:
    first = tables.priority_chunks(tables.workbook_kpi_summary(workbooks(spark, d))).withColumnRenamed("workbook", "doc_id")
    q = t.table(spark, d, "lineitem").groupBy(F.concat(F.col("l_orderkey").cast("string"), F.lit(".xlsx")).alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").cast("int").cast("string").alias("q"))
    chunks = q.select("doc_id", (F.col("n") - 1).cast("int").alias("chunk_index"), F.col("q").alias("text"))
    return tables.with_priority(chunks, first).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@query(
    "k17_recovered_summary",
    """SELECT p_partkey AS doc_id, '# KPI-сводка: ' || CASE WHEN p_partkey % 4 = 0 THEN 'KPI.xlsx' ELSE p_name END || chr(10) || 'Тег: enterprise_kpi — цитируй этот блок для KPI из Excel (%, тоннаж, крупность).' || chr(10) || chr(10)
 || CASE p_partkey % 3 WHEN 0 THEN '- Отвальные хвосты: ' || CAST(p_size AS VARCHAR) || ' т' ELSE '- Итого извлекаемый металл в хвостах: ' || CAST(p_size AS VARCHAR) || ',5%' END AS text FROM part WHERE p_partkey % 3 < 2""",
)
def k17(spark: SparkSession, d: str) -> DataFrame:
    """Parts as processed documents: a table row, a row behind prose, or none."""
    p, size = t.table(spark, d, "part"), F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Отвальные хвосты | "), size)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("проза: итого извлекаемый металл в сумме|"), size, F.lit(",5"))).otherwise(F.lit("no table"))
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("title"), text.alias("text"))
    return tables.recovered_summary(docs)


@query(
    "k23_experiment_metadata",
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q, max(l_discount) AS c, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
e AS (SELECT k % 40 AS sheet, CAST(k * 8 + n AS INT) AS row_idx, CASE WHEN n <> 2 THEN 'S' || CAST(k AS VARCHAR) END AS s, CAST(trunc(q) AS INT) + 0.5 AS ph, CAST(floor(p) AS DOUBLE) AS rec FROM r WHERE k % 5 <> 0),
x AS (SELECT *, coalesce(s, 'row_' || CAST(row_number() OVER (PARTITION BY sheet ORDER BY row_idx) AS VARCHAR)) AS sample FROM e)
SELECT CAST(sheet AS VARCHAR) AS sheet, row_idx, 'lab.xlsx#' || sample AS source, 'lab_' || sample AS assay_id, CAST(2 AS INT) AS factors, CAST(ph AS DOUBLE) AS ph, rec FROM x""",
)
def k23(spark: SparkSession, d: str) -> DataFrame:
    e = tables.experiment_rows(rec.experiments(spark, d), most=1 << 30).withColumn("m", tables.experiment_metadata(F.lit("lab.xlsx"), F.lit("lab")))
    return e.select("sheet", "row_idx", "m.source", "m.lab_record.assay_id", F.size("m.lab_record.factor_names").alias("factors"), F.col("m.process_parameters")["pH"].alias("ph"), F.col("m.measurement_results")["recovery_pct"].alias("rec"))


@query(
    "k25_experiment_documents",
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q, max(l_discount) AS c, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
e AS (SELECT k % 40 AS sheet, k * 8 + n AS row_idx, CASE WHEN n <> 2 THEN 'S' || CAST(k AS VARCHAR) END AS s, CAST(trunc(q) AS INT) + 0.5 AS ph, round(c * 100) AS dose, floor(p) AS rec FROM r WHERE k % 5 <> 0),
x AS (SELECT *, coalesce(s, 'row_' || CAST(row_number() OVER (PARTITION BY sheet ORDER BY row_idx) AS VARCHAR)) AS sample FROM e)
SELECT CAST(sheet AS VARCHAR) AS workbook, count(DISTINCT (sample, ph, dose, rec)) AS n_documents, count(*) AS n_experiments FROM x GROUP BY sheet""",
)
def k25(spark: SparkSession, d: str) -> DataFrame:
    """Each sheet as a workbook of its own."""
    rows = rec.experiments(spark, d).withColumns({"workbook": F.col("sheet"), "sheet": F.lit("")})
    return tables.experiment_documents(rows.withColumn("row_idx", F.col("row_idx")), most=1 << 30)[1]


# ---- text ----------------------------------------------------------------------------------------


@query(
    "t09_structure",
    """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 2 AND p_partkey % 5 <> 0 THEN '1. ' || p_name || chr(10) || 'rest' ELSE
 '# ' || CASE WHEN p_partkey % 5 = 0 THEN 'Материалы предприятия' ELSE 'Структурированный документ' END || ': ' || CASE WHEN p_partkey % 5 = 0 THEN 'Гипотезы.docx' ELSE 'a.docx' END || chr(10)
 || CASE WHEN p_partkey % 5 = 0 THEN 'Нумерованные направления — приоритет для RAG.' || chr(10) ELSE '' END
 || CASE WHEN len(w) > 0 THEN 'Ключевые темы: ' || array_to_string(w, ', ') || chr(10) ELSE '' END || chr(10)
 || '## ' || pre || ' 1: ' || p_name || chr(10) || CASE WHEN p_partkey % 3 = 2 THEN 'rest' ELSE 'between' || chr(10) || '## ' || pre || ' 2: ' || p_type END END AS text
 FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'Гипотеза' ELSE 'Пункт' END AS pre, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS w
  FROM (SELECT *, regexp_extract_all(lower(p_name || CASE WHEN p_partkey % 3 = 2 THEN '' ELSE ' ' || p_type END), '[а-яёa-z]{5,}') AS a FROM part))""",
)
def t09(spark: SparkSession, d: str) -> DataFrame:
    """Parts as documents of one numbered line or two; every fifth comes from a file of hypotheses."""
    p, k = t.table(spark, d, "part"), F.col("p_partkey")
    text = F.concat(F.lit("1. "), "p_name", F.when(k % 3 == 2, F.lit("\nrest")).otherwise(F.concat(F.lit("\nbetween\n2) "), "p_type")))
    name = F.when(k % 5 == 0, F.lit("Гипотезы.docx")).otherwise(F.lit("a.docx"))
    return p.select(k.alias("doc_id"), evaluation.enriched_structure(text, name).alias("text"))


@query("t26_entities", "SELECT n_nationkey AS id, CAST(n AS BIGINT) AS at, n_name || CAST(n AS VARCHAR) AS name, CASE WHEN n % 2 = 0 THEN 'Material' ELSE 'Parameter' END AS type FROM (SELECT *, unnest(range(0, 4)) AS n FROM nation) WHERE n <> 3 AND n_nationkey % 5 <> 4")
def t26(spark: SparkSession, d: str) -> DataFrame:
    """A nation's model output: three entities and one without a name, inside a fence; every fifth is broken."""
    item = lambda i: F.concat(F.lit('{"name": "'), F.when(F.lit(i) == 3, F.lit("")).otherwise(F.concat("n_name", F.lit(str(i)))), F.lit('"'), F.lit(', "type": "Material"}' if i % 2 == 0 else "}"))
    raw = F.concat(F.lit('```json\n{"entities": ['), F.concat_ws(", ", *[item(i) for i in range(4)]), F.when(F.col("n_nationkey") % 5 == 4, F.lit("")).otherwise(F.lit("]}\n```")))
    e = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.posexplode(hypotheses.entities(raw)).alias("at", "e"))
    return e.select("id", F.col("at").cast("long").alias("at"), "e.name", "e.type")


@query(
    "t29_ner_sample",
    r"""SELECT doc_id, md5(substr(CASE WHEN doc_id % 2 = 0 THEN 'Structured: {"measurement_results":{"recovery_pct":"' || CAST(n_chars AS VARCHAR) || '"},"process_parameters":{}}' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN length(text) <= 4500 THEN text ELSE substr(text, 1, 2000) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || substr(text, length(text) - 1499) END, 1, 4500)) AS digest FROM documents WHERE regexp_matches(text, '[^ \t\n\r\f\v]')""",
)
def t29(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").filter(F.col("text").rlike(r"[^ \t\n\r\f\x0B]"))
    known = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("recovery_pct"), F.col("n_chars").cast("string")))
    none = F.when(F.col("doc_id") % 2 == 0, F.create_map().cast("map<string,string>"))
    return docs.select("doc_id", F.md5(proposals.ner_sample(F.col("text"), known, none)).alias("digest"))


def region_contexts(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """A region is a query: its 12 richest suppliers are hits, its nations nodes and links; low balances are gaps."""
    s = t.table(spark, d, "supplier").join(t.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    hits = retrieval.ranked(s, ["n_regionkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 12)
    hits = hits.select(F.col("n_regionkey").alias("query_id"), "rank", F.col("s_suppkey").alias("doc_id"), F.col("n_name").alias("source"), (F.col("s_suppkey") % 8 / 8.0).alias("score"), F.col("s_name").alias("text"), (F.col("s_suppkey") % 2 == 0).alias("is_example"))
    n = t.table(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("at"), F.col("n_name").alias("id"), F.lit("Process").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("s")).alias("source"))
    links = n.select("query_id", "at", F.col("id").alias("source"), F.lit("kpi").alias("target"), F.lit("AFFECTS").alias("type"))
    gaps = t.table(spark, d, "region").filter("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("query_id"), F.lit(1).alias("rank"), F.col("r_name").alias("topic"), F.lit("high").alias("severity"))
    return hits, n, links, gaps


CONTEXTS = r"""h AS (SELECT n_regionkey AS q, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS r, * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
li AS (SELECT q, 0 AS part, r AS place, '[' || CAST(r AS VARCHAR) || ']' || CASE WHEN s_suppkey % 2 = 0 THEN ' [ПРИМЕР]' ELSE '' END || ' doc_id=' || CAST(s_suppkey AS VARCHAR) || ' source=' || n_name || ' score=' || printf('%.3f', s_suppkey % 8 / 8.0) || chr(10) || s_name AS line FROM h WHERE r <= 12
 UNION ALL SELECT DISTINCT n_regionkey, 1, 0, chr(10) || 'Knowledge graph excerpt:' FROM nation
 UNION ALL SELECT n_regionkey, 2, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '  - Process: ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' [s]' ELSE '' END FROM nation
 UNION ALL SELECT n_regionkey, 3, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '  → ' || n_name || ' --AFFECTS--> kpi' FROM nation
 UNION ALL SELECT r_regionkey, 4, 0, chr(10) || 'Knowledge gaps (address in hypotheses where possible):' FROM region WHERE r_regionkey % 2 = 0
 UNION ALL SELECT r_regionkey, 5, 1, '  - [high] ' || r_name FROM region WHERE r_regionkey % 2 = 0),
cx AS (SELECT q AS query_id, string_agg(line, chr(10) || chr(10) ORDER BY part, place) AS context FROM li GROUP BY q)"""


@query("t32_whole_context", "WITH " + CONTEXTS + " SELECT query_id, md5(context) AS digest FROM cx")
def t32(spark: SparkSession, d: str) -> DataFrame:
    return proposals.whole_context(*region_contexts(spark, d)).select("query_id", F.md5("context").alias("digest"))


@query(
    "t33_whole_prompts",
    "WITH " + CONTEXTS + r""" SELECT r_regionkey AS query_id, md5('Target problem:' || chr(10) || r_name || chr(10) || chr(10) || 'Constraints:' || chr(10) || CASE WHEN r_regionkey % 2 = 0 THEN 'none' ELSE 'pH 8' END || chr(10) || chr(10)
 || CASE WHEN r_regionkey % 2 = 1 THEN 'Case hints (ground every claim in snippet):' || chr(10) || '- pH гипотезы строго в диапазоне 8–10' || chr(10) || chr(10) ELSE '' END
 || 'Directions to distribute:' || chr(10) || (SELECT string_agg('  ' || CAST(k AS VARCHAR) || '. ' || n_name, chr(10) ORDER BY k) FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_regionkey = r_regionkey)) || chr(10) || chr(10)
 || CASE WHEN context IS NULL THEN '' ELSE 'Relevant sources and knowledge graph:' || chr(10) || context || chr(10) || chr(10) END || 'Hypotheses: ' || CAST(greatest(1, least(r_regionkey * 5, 12)) AS VARCHAR)) AS digest FROM region LEFT JOIN cx ON query_id = r_regionkey""",
)
def t33(spark: SparkSession, d: str) -> DataFrame:
    r = t.table(spark, d, "region")
    q = r.select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("problem"), F.when(F.col("r_regionkey") % 2 == 0, F.lit("")).otherwise(F.lit("pH 8")).alias("constraints"), (F.col("r_regionkey") * 5).alias("n"))
    topics = t.table(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("at"), F.col("n_name").alias("topic"))
    none = spark.createDataFrame([], "query_id int, rank int, message string")
    return proposals.whole_prompts(q, proposals.whole_context(*region_contexts(spark, d)), retrieval.rule_hints(q), none, topics).select("query_id", F.md5("prompt").alias("digest"))


# ---- cases ---------------------------------------------------------------------------------------


def registry(spark: SparkSession, d: str) -> DataFrame:
    n = t.table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("at"), F.col("n_nationkey").alias("id"), F.concat(F.lit("dir"), F.col("n_regionkey").cast("string")).alias("dir"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("label"), F.array(F.upper("n_name")).alias("keywords"), F.when(F.col("n_nationkey") % 3 != 0, F.array(F.concat(F.lit("hint "), "n_name"), F.lit("same"))).alias("hints"))


@query("s25_registry", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS case_no, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, CAST(n_nationkey AS VARCHAR)) AS label, lower(n_name) AS keyword, CAST(CASE WHEN n_nationkey % 3 <> 0 THEN 2 ELSE 0 END AS INT) AS hints FROM nation")
def s25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.case_registry(registry(spark, d)).select("case_no", "label", F.get("keywords", 0).alias("keyword"), F.size("hints").alias("hints"))


@query(
    "r11_all_hints",
    """WITH q AS (SELECT c_custkey AS query_id, c_custkey % 3 = 0 AS ph, c_custkey % 4 = 0 AS capex, n_nationkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT query_id, 0 AS part, 1 AS place, coalesce(CASE WHEN k % 2 = 0 THEN n_name END, CAST(k AS VARCHAR)) || ': hint ' || n_name AS hint FROM q WHERE k % 3 <> 0
 UNION ALL SELECT query_id, 0, 2, coalesce(CASE WHEN k % 2 = 0 THEN n_name END, CAST(k AS VARCHAR)) || ': same' FROM q WHERE k % 3 <> 0
 UNION ALL SELECT query_id, 1, 1, 'Только лабораторные/пилотные испытания на существующем оборудовании, TRL 4' FROM q WHERE capex UNION ALL SELECT query_id, 1, 2, 'pH гипотезы строго в диапазоне 8–10' FROM q WHERE ph)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS INT) AS rank, hint FROM h""",
)
def r11(spark: SparkSession, d: str) -> DataFrame:
    """A customer asks for its nation's case, under constraints."""
    c, k = t.table(spark, d, "customer"), F.col("c_custkey")
    said = F.concat(F.when(k % 3 == 0, F.lit("keep pH 8-9. ")).otherwise(F.lit("")), F.when(k % 4 == 0, F.lit("Без капитальных вложений")).otherwise(F.lit("")))
    cases = retrieval.case_registry(registry(spark, d))
    q = c.select(k.alias("query_id"), F.lit("raise yield").alias("problem"), said.alias("constraints"))
    routes = c.join(cases, F.col("id") == F.col("c_nationkey")).select(k.alias("query_id"), "case_no", "dir")
    return retrieval.all_hints(q, routes, cases)


@query(
    "r14_case_candidates",
    """WITH s AS (SELECT source AS dir, row_number() OVER (ORDER BY source) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
ch AS (SELECT dir, doc_id, source, text, row_number() OVER (PARTITION BY dir ORDER BY doc_id) AS k FROM documents JOIN s ON contains(lower(source), lower(dir))),
r AS (SELECT item_id AS query_id, dir FROM benchmark JOIN s ON item_id % total = n WHERE item_id % 3 < 2)
SELECT query_id, doc_id, CAST(0.9 + CASE WHEN contains(lower(source), 'гипотез') THEN 0.12 ELSE 0 END AS DOUBLE) AS score, CAST(0.5 AS DOUBLE) AS example_score FROM r JOIN ch USING (dir) WHERE k <= 12 AND coalesce(text, '') <> ''""",
)
def r14(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark item asks for one source's documents; every third has two mandatory chunks already."""
    docs = t.table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", F.lit(0).alias("chunk_index"), "text", "source")
    names = docs.select("source").distinct()
    numbered = retrieval.ranked(names, [], [F.asc("source")], None, "n").withColumn("n", F.col("n") - 1)  # sources are few
    total = numbered.agg(F.count("*").alias("total"))
    b = t.table(spark, d, "benchmark").join(total, F.lit(True))
    routes = b.join(numbered, F.col("item_id") % F.col("total") == F.col("n")).select(F.col("item_id").alias("query_id"), F.col("source").alias("dir"))
    mandatory = b.filter("item_id % 3 = 2").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))))
    q = b.select(F.col("item_id").alias("query_id"), F.array().cast("array<string>").alias("keywords"))
    found = retrieval.case_candidates(docs, routes, q, mandatory).filter(F.coalesce("text", F.lit("")) != "")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.round(F.col("example_score") - tx.kpi_boost(F.col("text")), 6).alias("example_score"))


# ---- citations -----------------------------------------------------------------------------------


@query("c03_citation_overlap", "WITH " + "it AS (SELECT item_id, text AS snippet FROM benchmark) SELECT item_id, 1.0 AS overlap FROM it WHERE length(regexp_replace(snippet, '[^\\p{L}]', '', 'g')) > 0")
def c03(spark: SparkSession, d: str) -> DataFrame:
    """A passage within itself."""
    b = t.table(spark, d, "benchmark").filter(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) > 0)
    return b.select("item_id", citations.citation_overlap(F.col("text"), F.concat(F.lit("before "), "text", F.lit(" behind"))).alias("overlap"))


@query(
    "c04_terms",
    "WITH " + t.HYPOTHESES + r""", w AS (SELECT hyp_id, regexp_extract_all(lower(text), '[а-яёa-z]{6,}') AS a FROM hyp), u AS (SELECT hyp_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS a FROM w)
SELECT hyp_id, array_to_string(list_concat(['pH\s*\d'], a)[1:12], ';') AS terms FROM u""",
)
def c04(spark: SparkSession, d: str) -> DataFrame:
    return t.hypotheses(spark, d).select("hyp_id", F.array_join(citations.hypothesis_terms(F.col("text")), ";").alias("terms"))


@query(
    "c10_aligned_sources",
    "WITH " + t.HYPOTHESES + """ SELECT hyp_id, CASE WHEN hyp_id % 3 = 1 THEN 'x' ELSE 'd' END || CAST(o_custkey % 7 AS VARCHAR) AS doc_id, hyp_id % 3 <> 2 AS own FROM hyp JOIN orders ON o_orderkey = hyp_id WHERE hyp_id % 3 <> 1
 UNION ALL SELECT hyp_id, 'd0', false FROM hyp WHERE hyp_id % 3 = 1""",
)
def c10(spark: SparkSession, d: str) -> DataFrame:
    """Every hypothesis cites one of its run's seven hits by number, verbatim, or an unknown one, or in words of its own that alignment replaces."""
    o = t.table(spark, d, "orders")
    body = F.concat(F.lit("The line of hit number "), F.col("k").cast("string"), F.lit(" tells of recovery and of grinding in mills. "), F.lit("Other matter follows here. "))
    runs = spark.range(25).select(F.col("id").cast("string").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    hits = runs.select("query_id", F.concat(F.lit("d"), F.col("k").cast("string")).alias("doc_id"), (F.col("k") + 1).alias("rank"), body.alias("text"))
    kind, k = F.col("o_orderkey") % 3, F.col("o_custkey") % 7
    snippet = F.when(kind == 2, F.lit("entirely different wording without common ground")).otherwise(F.concat(F.lit("The line of hit number "), k.cast("string"), F.lit(" tells of recovery")))
    cited = o.select(F.col("o_orderkey").alias("hyp_id"), (F.col("o_custkey") % 25).cast("string").alias("query_id"), F.lit(0).alias("at"), F.concat(F.when(kind == 1, F.lit("none-")).otherwise(F.lit("d")), k.cast("string")).alias("cited_id"), snippet.alias("snippet"), F.lit("grinding in mills").alias("hypothesis"))
    out = hypotheses.clean_sources(cited, hits)
    return out.select("hyp_id", "doc_id", F.col("snippet").startswith("The line of hit number ") .alias("own")).withColumn("own", F.col("own") & (F.col("hyp_id") % 3 == 0))


# ---- checks and verdicts -------------------------------------------------------------------------


def whole_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses with graph_issues (h15) and business cases of which some lack a part."""
    h, k = t.hypotheses(spark, d), F.col("hyp_id")
    issues = graphs.validate(rec.measures(spark, d)).select("hyp_id", F.col("issues").alias("graph_issues"))
    case = F.struct(F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("recovery")).alias("target_kpi"), F.when(k % 9 != 0, F.lit(3.0)).alias("delta_pct"), F.lit(None).cast("double").alias("revenue"), F.when(k % 4 == 0, F.lit("short")).otherwise(F.repeat(F.lit("long "), 10)).alias("narrative"))
    return h.join(issues, "hyp_id").withColumn("business_case", F.when(k % 8 != 3, case))


HARD = "(n_nodes < 2 OR n_links < 1 OR n_kpi = 0 OR n_nodes - n_kpi = 0 OR has_source)"
J13 = "j AS (SELECT hyp_id, NOT " + HARD + " AS graph_ok, NOT (hyp_id % 8 = 3 OR hyp_id % 7 = 0 OR hyp_id % 9 = 0 OR hyp_id % 4 = 0) AS case_ok FROM gm)"


@query("j13_checks", "WITH " + rec.MEASURES + ", " + J13 + " SELECT hyp_id, 'influence_graph' AS key, graph_ok AS passed FROM j UNION ALL SELECT hyp_id, 'business_case', case_ok FROM j")
def j13(spark: SparkSession, d: str) -> DataFrame:
    checked = judging.checks(whole_hypotheses(spark, d), F.lit("recovery of metal increases"), judging.WHOLE_CHECKS)
    return checked.filter("key IN ('influence_graph', 'business_case')").select("hyp_id", "key", "passed")


@query(
    "j14_whole_compliance",
    "WITH " + t.HYPOTHESES + ", " + rec.CHECKS + ", " + rec.COMPLIANCE + ", " + rec.MEASURES + ", " + J13 + " SELECT hyp_id, mandatory_passed, optional_passed + CAST(graph_ok AS INT) + CAST(case_ok AS INT) AS optional_passed, CAST(5 AS BIGINT) AS optional_total, mandatory_passed = 7 AS all_mandatory_met FROM cp JOIN j USING (hyp_id)",
)
def j14(spark: SparkSession, d: str) -> DataFrame:
    checked = judging.checks(whole_hypotheses(spark, d), F.lit("recovery of metal increases"), judging.WHOLE_CHECKS)
    return judging.compliance(checked).select("hyp_id", "mandatory_passed", "optional_passed", "optional_total", "all_mandatory_met")


RULED = "('ставим новое оборудование', 'капитальные вложения невелики', 'без капитальных вложений', 'испытания на заводе', 'опыт в лаборатории')"


@query(
    "j16_rules",
    """WITH k AS (SELECT o_orderkey AS hyp_id, o_orderkey % 5 AS w, o_orderkey % 3 AS c FROM orders)
SELECT hyp_id, 'capex' AS kind FROM k WHERE c IN (0, 2) AND w IN (0, 1) UNION ALL SELECT hyp_id, 'trl' FROM k WHERE c IN (1, 2) AND w = 3""",
)
def j16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*[F.lit(x) for x in eval_tuple(RULED)]), (k % 5 + 1).cast("int"))
    said = F.element_at(F.array(F.lit("Без капитальных затрат"), F.lit("уровень TRL 4"), F.lit("без капвложений, TRL4")), (k % 3 + 1).cast("int"))
    h = t.table(spark, d, "orders").select(k.alias("hyp_id"), text.alias("text"), F.lit(None).cast("string").alias("mechanism"), F.lit("").alias("reasoning"), said.alias("said"))
    return judging.constraint_issues(h, F.col("said")).select("hyp_id", "kind")


def eval_tuple(text: str) -> tuple[str, ...]:
    return tuple(x.strip(" '") for x in text.strip("()").split(","))


@query(
    "j17_constrained",
    rec.WITH_VERDICT + ", k AS (SELECT hyp_id, greatest(hyp_id % 14, 7) > least(hyp_id % 14 + 2, 9) OR hyp_id % 3 = 0 AS breaks FROM hyp) SELECT hyp_id, approved AND NOT breaks AS approved FROM va JOIN k USING (hyp_id)",
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    """As j17_verdict, with the constraint's issues counted."""
    v = judging.with_constraint_issues(rec.verdicts(spark, d).drop("n_constraint_issues", "overall_score", "approved"), F.lit("keep pH 7-9"))
    return judging.verdict(v).select("hyp_id", "approved")


@query(
    "b04_narrative",
    "WITH " + t.HYPOTHESES + """, b AS (SELECT *, hyp_id % 19 AS stated FROM hyp), e AS (SELECT *, CASE WHEN stated <= 15 THEN CAST(stated AS DOUBLE) WHEN expected_value >= 7 THEN round(2.0 + (expected_value - 7) * 1.5, 1) END AS delta FROM b),
x AS (SELECT *, 2000000.0 * delta / 3 AS benefit FROM e)
SELECT hyp_id, contains('x', 'x') AS has_kpi, delta IS NOT NULL AS has_delta, coalesce(delta > 0, false) AS has_money, 'Оценка ценности LLM: ' || printf('%.1f', expected_value) || '/10; реализуемость: ' || printf('%.1f', feasibility) || '/10.' AS ending FROM x""",
)
def b04(spark: SparkSession, d: str) -> DataFrame:
    case = business.business_case(t.hypotheses(spark, d), F.lit("recovery of metal"), F.lit(True), F.size("sources"))
    n = F.col("narrative")
    return case.select("hyp_id", n.startswith("Целевой KPI: **извлечение / выход** по задаче «recovery of metal».").alias("has_kpi"), n.contains("Ожидаемый прирост").alias("has_delta"), (n.contains("руб/год") & n.contains("Окупаемость")).alias("has_money"), F.regexp_extract("narrative", r"(Оценка ценности.*)$", 1).alias("ending"))


# ---- graphs --------------------------------------------------------------------------------------


@query(
    "h10_supplied_graph",
    "SELECT l_orderkey AS hyp_id, CAST(count(DISTINCT l_linenumber) AS INT) AS nodes, CAST(count(DISTINCT CASE WHEN l_linenumber <> 2 THEN l_linenumber END) AS INT) AS links, count(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END) AS processes FROM lineitem GROUP BY 1",
)
def h10(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as a graph: plain names and objects, ends by either name, a link without a target, a node without an id."""
    n = F.col("l_linenumber")
    li = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    name = F.concat(F.lit("n"), n.cast("string"))
    node = F.when(n % 2 == 0, F.concat(F.lit('{"id": "'), name, F.lit('", "type": "Process"}'))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    link = F.concat(F.when(n % 2 == 0, F.lit('{"from": "')).otherwise(F.lit('{"source": "')), name, F.when(n == 2, F.lit('"}')).otherwise(F.lit('", "to": "kpi"}')))
    raw = li.groupBy("l_orderkey").agg(F.concat(F.lit('{"nodes": ['), F.array_join(F.collect_list(node), ", "), F.lit(', {"type": "x"}, ""], "links": ['), F.array_join(F.collect_list(link), ", "), F.lit("]}")).alias("raw"))
    g = raw.select(F.col("l_orderkey").alias("hyp_id"), graphs.supplied_graph(F.col("raw")).alias("g"))
    return g.select("hyp_id", F.size("g.nodes").alias("nodes"), F.size("g.links").alias("links"), F.size(F.filter("g.nodes", lambda x: x["type"] == "Process")).cast("long").alias("processes"))


CAUSAL = """cg AS (SELECT hyp_id, 'recovery' AS id, 'Property' AS type FROM hyp UNION ALL SELECT hyp_id, 'процесс обогащения', 'Process' FROM hyp
 UNION ALL SELECT hyp_id, 'pH ' || CAST(hyp_id % 14 AS VARCHAR) || '-' || CAST(hyp_id % 14 + 2 AS VARCHAR), 'Parameter' FROM hyp UNION ALL SELECT hyp_id, 'pH 9.5', 'Parameter' FROM hyp WHERE hyp_id % 3 = 0 UNION ALL SELECT hyp_id, mechanism, 'Material' FROM hyp)"""


@query("h12_causal_nodes", "WITH " + t.HYPOTHESES + ", " + CAUSAL + " SELECT hyp_id, id, type FROM cg")
def h12(spark: SparkSession, d: str) -> DataFrame:
    h = t.hypotheses(spark, d)
    g = h.select("hyp_id", graphs.causal_graph(F.concat_ws(" ", "text", "mechanism"), F.col("mechanism"), F.lit("d")).alias("g"))
    return g.select("hyp_id", F.explode("g.nodes").alias("n")).select("hyp_id", "n.id", "n.type")


@query(
    "h14_whole_graph",
    "WITH " + t.HYPOTHESES + ", " + CAUSAL + """, s AS (SELECT hyp_id, len(roadmap) AS n FROM hyp), a AS (SELECT hyp_id, count(*) AS nodes FROM cg GROUP BY 1)
SELECT hyp_id, CASE WHEN hyp_id % 4 = 1 THEN 2 ELSE nodes END + s.n AS nodes, CASE WHEN hyp_id % 4 = 1 THEN 1 ELSE nodes - 1 END + 1 AS links, CAST(1 AS BIGINT) AS validates, CASE WHEN has_source THEN CASE WHEN hyp_id % 4 = 1 THEN 2 ELSE nodes END ELSE 0 END AS sourced FROM a JOIN s USING (hyp_id) JOIN hyp USING (hyp_id)""",
)
def h14(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth hypothesis brings a graph of its own; another fourth one that is too small and is filled up."""
    k = F.col("hyp_id")
    raw = F.when(k % 4 == 1, F.lit('{"nodes": [{"id": "KPI x", "type": "Property"}, "mill"], "links": [{"source": "mill", "target": "KPI x"}]}')).when(k % 4 == 2, F.lit('{"nodes": [], "links": []}'))
    h = t.hypotheses(spark, d).withColumns({"problem": F.lit(""), "graph": raw})
    nodes, links, _ = graphs.whole_graph(h)
    n = nodes.groupBy("hyp_id").agg(F.count("*").alias("nodes"), F.count("source_doc_id").alias("sourced"))
    m = links.groupBy("hyp_id").agg(F.count("*").alias("links"), F.count_if(F.col("type") == "VALIDATES").alias("validates"))
    return n.join(m, "hyp_id").select("hyp_id", "nodes", "links", "validates", "sourced")


@query(
    "s20_relations",
    """WITH r AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, CASE WHEN l_returnflag = 'R' THEN 'AFFECTS' ELSE 'CORRELATES_WITH' END AS type FROM lineitem)
SELECT source, CASE WHEN CAST(substr(source, 2) AS INT) % 2 = 0 THEN 'Process' ELSE 'Parameter' END AS source_label, target, type FROM r""",
)
def s20(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem")
    r = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.when(F.col("l_returnflag") == "R", F.lit("affects")).otherwise(F.lit("touches")).alias("type"))
    e = t.table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.lit("Process").alias("label"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    return graphs.upsert_relations(r, e)[0].select("source", "source_label", "target", "type")


@query("s20_publications", "SELECT 'doc:' || CAST(l_orderkey AS VARCHAR) AS publication, count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS named FROM lineitem GROUP BY 1")
def s20b(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem")
    r = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.lit("AFFECTS").alias("type"))
    e = t.table(spark, d, "supplier").select(F.lit("Process").alias("label"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    return graphs.upsert_relations(r, e)[1].groupBy("publication").agg(F.count("*").alias("named"))


@query(
    "h18_merge_relations",
    "SELECT l_orderkey AS doc_id, l_shipdate_kind AS type, count(DISTINCT l_suppkey) AS n FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'CORRELATES_WITH' ELSE 'USED_IN' END AS l_shipdate_kind FROM lineitem) GROUP BY ALL",
)
def h18(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem")
    name = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("Supplier ")).otherwise(F.lit("SUPPLIER ")), F.col("l_suppkey").cast("string"))
    parts = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("origin"), F.col("l_linenumber").alias("at"), name.alias("source"), F.lit("process").alias("target"), F.when(F.col("l_returnflag") == "A", F.lit("unknown")).otherwise(F.lit("used_in")).alias("type"))
    loops = parts.withColumn("target", F.lower("source"))
    return graphs.merge_relations(parts.union(loops)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


# ---- evaluation and feedback ---------------------------------------------------------------------


@query(
    "v04_table_facts",
    """SELECT o_orderkey AS case_id, CAST(o_orderkey % 90 AS DOUBLE) + 0.5 AS recoverable_pct, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END AS tailings_tonnage, CASE WHEN o_orderkey % 2 = 0 THEN '+44;-44' ELSE '' END AS sizes FROM orders""",
)
def v04(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rendered tables in either layout, some without tonnage or size classes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    share = F.concat((k % 90).cast("string"), F.lit(",5"))
    text = F.concat_ws(
        "\n", F.when(k % 2 == 0, F.concat(F.lit("- Итого извлекаемый металл в хвостах: "), share, F.lit("%"))).otherwise(F.concat(F.lit("Итого извлекаемый металл | | "), share)),
        F.when(k % 3 == 1, F.concat(F.lit("- Отвальные хвосты: "), c, F.lit(" т"))).when(k % 3 == 2, F.concat(F.lit("Отвальные хвосты | "), c)), F.when(k % 2 == 0, F.lit("- +44 мкм: 1\n| -44 мкм")),
    )
    f = t.table(spark, d, "orders").select(k.alias("case_id"), evaluation.table_facts(text).alias("f"))
    return f.select("case_id", "f.recoverable_pct", "f.tailings_tonnage", F.array_join("f.grain_classes", ";").alias("sizes"))


@query(
    "v07_case_documents",
    "SELECT c_custkey AS case_id, (SELECT min('Customer ' || CAST(c_custkey % 50 AS VARCHAR) || '_' || CAST(x AS VARCHAR)) FROM range(1, 4) r(x)) AS doc_id FROM customer WHERE c_custkey % 50 < 25 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 50 >= 25",
)
def v07a(spark: SparkSession, d: str) -> DataFrame:
    """Stems of which half have processed documents, three each."""
    k = F.col("c_custkey") % 50
    stem = F.concat(F.lit("Customer "), k.cast("string"), F.lit("_"))
    c = t.table(spark, d, "customer")
    docs = c.select(k.alias("k")).distinct().filter("k < 25").select("k", F.explode(F.array(*[F.lit(str(i)) for i in (3, 1, 2)])).alias("i")).select(F.concat(F.lit("Customer "), F.col("k").cast("string"), F.lit("_"), "i").alias("doc_id"))
    return evaluation.case_documents(c.select(F.col("c_custkey").alias("case_id"), stem.alias("stem")), docs)


@query(
    "v07_case_report",
    rec.WITH_VERDICT + """, run AS (SELECT run_id AS case_id, count(*) AS total, count(*) FILTER (approved) AS n_approved, round(avg(CAST(source_grounded AS INT)), 6) AS grounding_rate FROM va GROUP BY 1),
c AS (SELECT CAST(unnest(range(0, 30)) AS VARCHAR) AS case_id)
SELECT case_id, CASE WHEN CAST(case_id AS INT) % 2 = 0 THEN 0.5 ELSE 0.0 END AS recall, CASE WHEN CAST(case_id AS INT) % 3 = 0 THEN true END AS hit, total, n_approved, grounding_rate FROM c LEFT JOIN run USING (case_id)""",
)
def v07(spark: SparkSession, d: str) -> DataFrame:
    c = spark.range(30).select(F.col("id").cast("string").alias("case_id"), "id")
    recall = c.filter("id % 2 = 0").select("case_id", F.lit(4).cast("long").alias("topics"), F.lit(2).cast("long").alias("found"), F.lit(0.5).alias("recall"))
    facts = c.select("case_id", evaluation.table_facts(F.lit("- Отвальные хвосты: 5 т")).alias("facts"))
    hits = c.filter("id % 3 = 0").select("case_id", F.lit(True).alias("hit"))
    runs = judging.run_index(rec.verdicts(spark, d)).withColumnRenamed("run_id", "case_id")
    support = evaluation.citation_support(t.hypotheses(spark, d).select("run_id", "text", F.get("sources", 0)["snippet"].alias("snippet"))).withColumnRenamed("run_id", "case_id")
    report = evaluation.case_report(c, recall, facts, hits, runs, support)
    return report.select("case_id", "recall", "hit", "total", "n_approved", F.round("grounding_rate", 6).alias("grounding_rate"))


@query("v09_failed_labels", "WITH " + t.HYPOTHESES + ", " + rec.CHECKS + " SELECT key, bool_or(i < 7) AS required, count(*) AS n FROM ck WHERE NOT passed GROUP BY key ORDER BY n DESC, key LIMIT 10")
def v09(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.failed_labels(rec.checked(spark, d))


@query("v09_graph_share", "WITH " + rec.MEASURES + ", c AS (SELECT CASE WHEN n_nodes >= 3 THEN 0.25 ELSE 0 END + CASE WHEN n_links >= 2 THEN 0.2 ELSE 0 END + CASE WHEN n_kpi > 0 THEN 0.15 ELSE 0 END + 0.2 AS x FROM gm) SELECT count(*) AS total, count(*) FILTER (x < 0.5) AS incomplete, round(avg(CAST(x < 0.5 AS INT)), 3) AS share FROM c")
def v09b(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.graph_share(rec.measures(spark, d).select(graphs.completeness().alias("completeness")))


@query(
    "v12_index_summary",
    """SELECT count(*) AS files, count(*) FILTER (p_partkey % 4 = 0) AS indexed_before, count(*) FILTER (p_partkey % 4 = 1) AS ingested, count(*) FILTER (p_partkey % 4 = 2) AS skipped, count(*) FILTER (p_partkey % 4 = 3) AS errors, CAST(coalesce(sum(p_size) FILTER (p_partkey % 4 = 1), 0) AS BIGINT) AS chunks FROM part""",
)
def v12(spark: SparkSession, d: str) -> DataFrame:
    p, k = t.table(spark, d, "part"), F.col("p_partkey")
    path = k.cast("string").alias("path")
    results = p.filter(k % 4 != 0).select(path, F.when(k % 4 == 1, F.col("p_size")).otherwise(0).alias("n_chunks"), F.when(k % 4 == 3, F.lit("broken")).alias("error"))
    return evaluation.index_summary(p.select(path), p.filter(k % 4 == 0).select(path), results)


FEEDBACK = t.EVENTS + """, ex AS (SELECT status, substr(text, 1, 80) AS prefix, min(ts) AS first_ts FROM ev GROUP BY ALL), er AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY first_ts DESC, prefix) AS rank FROM ex)"""


@query("f06_example_hints", "WITH " + FEEDBACK + " SELECT CASE status WHEN 'confirmed' THEN 'exemplar' ELSE 'anti_pattern' END AS kind, CAST(rank AS INT) AS at, prefix AS hint FROM er WHERE rank <= 2 AND status <> 'needs_review'")
def f06(spark: SparkSession, d: str) -> DataFrame:
    e = t.events(spark, d)
    averages = feedback.profiles(scores(e))
    return feedback.hints(feedback.keyword_counts(e), averages, feedback.exemplars(e)).filter("kind IN ('exemplar', 'anti_pattern')")


def scores(e: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in feedback.CRITERIA])
    return e.select("status", F.explode(pairs).alias("p")).select("status", "p.*").filter("score IS NOT NULL")


@query(
    "f11_snapshot",
    "WITH " + FEEDBACK + """, pr AS (SELECT status = 'confirmed' AS good, novelty FROM ev WHERE novelty IS NOT NULL)
SELECT (SELECT count(*) FROM ev WHERE status = 'confirmed') AS confirmed_count, (SELECT count(*) FROM ev WHERE status = 'rejected') AS rejected_count, (SELECT round(sum(novelty), 3) FROM pr WHERE good) AS novelty_total, (SELECT count(*) FROM pr WHERE NOT good) AS novelty_rejected,
CAST((SELECT least(5, count(*)) FROM ex WHERE status = 'confirmed') AS INT) AS exemplars, CAST((SELECT least(5, count(*)) FROM ex WHERE status = 'rejected') AS INT) AS anti_patterns""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    e = t.events(spark, d)
    words, profiles, patterns = feedback.keyword_counts(e), feedback.profiles(scores(e)), feedback.exemplars(e)
    s = feedback.snapshot(feedback.counters(e), words, profiles, patterns, feedback.hints(words, profiles, patterns))
    p = F.col("score_profiles")
    return s.select("confirmed_count", "rejected_count", F.round(p["confirmed"]["novelty"]["total"], 3).alias("novelty_total"), p["rejected"]["novelty"]["n"].alias("novelty_rejected"), F.size("exemplars").alias("exemplars"), F.size("anti_patterns").alias("anti_patterns"))


@query("f07_expert_fold")
def f07(spark: SparkSession, d: str) -> DataFrame:
    """Every third event has expert scores, which move the weights alone."""
    e = t.events(spark, d)
    expert = {f"expert_{c}": F.when(F.col("event_id") % 3 == 0, (F.col("event_id") * (i + 3) % 11).cast("double")) for i, c in enumerate(feedback.CRITERIA)}
    return feedback.fold_weights(e.withColumns(expert))


# ---- whole proposals -----------------------------------------------------------------------------


def proposal_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """A run's hits are 16 documents of its number; its samples are orders that cite one of them, verbatim or in words of their own."""
    docs = t.table(spark, d, "documents").filter(F.length("text") >= 60).select("doc_id", "text", (F.col("doc_id") % 25).cast("string").alias("query_id"))
    hits = retrieval.ranked(docs, ["query_id"], [F.asc(F.xxhash64("doc_id")), F.asc("doc_id")], 16).select("query_id", "rank", "doc_id", F.lit(0).alias("chunk_index"), "text", (1 / F.col("rank")).alias("score"))
    p = spark.range(25).select(F.col("id").cast("string").alias("query_id"), F.concat(F.lit("raise recovery of metal "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, F.lit(". Constraints: pH 6-12")).otherwise(F.lit(""))).alias("problem"), F.lit("").alias("constraints"))
    h = t.hypotheses(spark, d).withColumn("at", (F.col("hyp_id") % 16 + 1).cast("int"))
    cited = h.join(hits.select(F.col("query_id").alias("run_id"), F.col("rank").alias("at"), F.col("doc_id").cast("string").alias("cited"), F.col("text").alias("cited_text")), ["run_id", "at"])
    snippet = F.when(F.col("hyp_id") % 5 == 0, F.lit("zzzz qqqq entirely other words")).otherwise(F.substring(F.regexp_replace("cited_text", r"\s+", " "), 1, 120))
    body = F.struct(
        "text", "mechanism", "reasoning", F.col("novelty").alias("novelty_score"), F.col("feasibility").alias("feasibility_score"), F.col("expected_value").alias("expected_value_score"),
        F.struct(F.col("risk_technical").alias("technical"), F.col("risk_economic").alias("economic")).alias("risk"), "roadmap", F.array(F.struct(F.col("cited").alias("doc_id"), snippet.alias("snippet"))).alias("sources"),
    )
    samples = cited.select("run_id", F.col("hyp_id").alias("sample_no"), F.to_json(body).alias("raw"))
    return p, hits, samples


def reviews_of(numbered: DataFrame) -> DataFrame:
    """A review for each hypothesis whose number is no multiple of 4."""
    n = F.regexp_extract("hyp_id", r"-h(\d+)$", 1).cast("int")
    q = F.lit(8.0)
    return numbered.select("hyp_id").filter(n % 4 != 0).select("hyp_id", q.alias("testability"), q.alias("evidence_quality"), q.alias("relevance"), q.alias("novelty_assessment"), q.alias("kpi_link"), F.lit(True).alias("review_approved"))


@query("h19_generate")
def h19(spark: SparkSession, d: str) -> DataFrame:
    """Whole proposals of 25 runs: what is approved, grounded, and in which order."""
    problems, hits, samples = proposal_inputs(spark, d)
    ids = spark.range(25).select(F.explode(F.sequence(F.lit(0), F.lit(5000))).alias("n"), F.col("id").cast("string").alias("r")).select(F.concat("r", F.lit("-h"), F.col("n").cast("string")).alias("hyp_id"))
    return proposals.generate(problems, hits, samples, reviews_of(ids))["hypotheses"].select("run_id", "hyp_id", "rank", "approved", "source_grounded", "n_constraint_issues", "mandatory_passed", F.round("objective", 4).alias("objective"))


@query("j04_enriched")
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Enriched hypotheses: roadmap, predictive score, business case, graph and composite."""
    h = t.hypotheses(spark, d).withColumns({"query_id": F.col("run_id"), "problem": F.lit("recovery of metal"), "baseline": F.lit(None).cast("double")})
    _, hits, _ = proposal_inputs(spark, d)
    gaps = spark.createDataFrame([], "query_id string, severity string")
    e = proposals.enriched(h, hits, gaps, F.lit(True))
    return e.select("hyp_id", F.size("roadmap").alias("steps"), "predictive", "business_case.delta_pct", "completeness", F.round("composite", 6).alias("composite"))


# ---- sources and exports -------------------------------------------------------------------------


@query(
    "s10_ingested",
    r"""SELECT CAST(doc_id AS VARCHAR) AS source, NOT regexp_matches(coalesce(text, ''), '[^ \t\n\r\f\v]') AND doc_id % 11 <> 3 AS skipped, CASE WHEN doc_id % 11 = 3 THEN 'unreadable' END AS error, doc_id % 11 <> 3 AND regexp_matches(coalesce(text, ''), '[^ \t\n\r\f\v]') AS has_chunks FROM documents WHERE doc_id % 4 <> 0""",
)
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: a quarter is indexed already, every eleventh could not be read."""
    docs, k = t.table(spark, d, "documents"), F.col("doc_id")
    texts = docs.select(k.cast("string").alias("source"), F.when(k % 11 != 3, F.col("text")).alias("text"), F.when(k % 11 == 3, F.lit("unreadable")).alias("error"))
    _, results = files.ingested(texts, docs.filter(k % 4 == 0).select(k.cast("string").alias("source")))
    return results.select("source", "skipped", "error", (F.col("chunks_indexed") > 0).alias("has_chunks"))


@query(
    "s14_rows_document",
    "SELECT n_regionkey, md5('# nations' || chr(10) || '## Columns: n_nationkey, n_name' || chr(10) || string_agg('Row ' || CAST(k AS VARCHAR) || ': n_nationkey=' || CAST(n_nationkey AS VARCHAR) || ' | n_name=' || n_name, chr(10) ORDER BY k)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY 1",
)
def s14(spark: SparkSession, d: str) -> DataFrame:
    n = t.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return stores.rows_document(n, "nations", ["n_nationkey"], ["n_regionkey"]).select("n_regionkey", F.md5("text").alias("digest"))


@query("s22_run_list", "WITH " + t.HYPOTHESES + " SELECT run_id, count(*) AS hypotheses, count(*) FILTER (hyp_id % 3 = 0) AS approved, max(hyp_id) AS created_at FROM hyp GROUP BY 1")
def s22(spark: SparkSession, d: str) -> DataFrame:
    h = t.hypotheses(spark, d)
    return stores.run_list(h.select("run_id", "hyp_id", (F.col("hyp_id") % 3 == 0).alias("approved"), F.col("hyp_id").alias("created_at")))


@query(
    "s23_nested_task",
    "WITH " + t.HYPOTHESES + " SELECT hyp_id, substr(text, 1, 120) AS summary, novelty, CAST(len(roadmap) AS INT) AS steps, 'Механизм: ' || mechanism || chr(10) || chr(10) || 'Обоснование: ' || reasoning || chr(10) || chr(10) || 'Score: 0.5' AS description FROM hyp",
)
def s23(spark: SparkSession, d: str) -> DataFrame:
    h = t.hypotheses(spark, d).withColumns({"composite": F.lit(0.5), "approved": F.lit(True)})
    task = stores.task_json(h).withColumn("j", F.from_json("task", "summary string, description string, custom_fields struct<novelty:double>, roadmap array<string>"))
    return task.select("hyp_id", "j.summary", "j.custom_fields.novelty", F.size("j.roadmap").alias("steps"), "j.description")


@query("t21_relative_source", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/other/' || CAST(page_id AS VARCHAR) ELSE 'docs/' || CAST(page_id AS VARCHAR) || '.html' END AS source FROM pages")
def t21(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/other/"), k)).otherwise(F.concat(F.lit("/data/docs/"), k, F.lit(".html")))
    return t.table(spark, d, "pages").select("page_id", proposals.relative_source(path, "/data").alias("source"))


@query(
    "r19_subgraph_nodes",
    "WITH " + t.GRAPH + ", h AS (SELECT id, name FROM nd WHERE contains(lower(name), 'an') OR contains(lower(name), 'red')), e AS (SELECT source AS id, target AS other, type FROM ed UNION ALL SELECT target, source, type FROM ed), p AS (SELECT h.id, other FROM h LEFT JOIN e USING (id) ORDER BY h.id, other NULLS FIRST, type LIMIT 30), x AS (SELECT id, 0 AS hop FROM p UNION ALL SELECT other, 1 FROM p WHERE other IS NOT NULL) SELECT id, name, label, CAST(min(hop) AS INT) AS hop FROM x JOIN nd USING (id) GROUP BY id, name, label",
)
def r19(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.subgraph_nodes(*t.graph(spark, d), ["an", "RED"])


@query(
    "b06_counterfactual_text",
    "WITH " + t.HYPOTHESES + """, x AS (SELECT *, CASE WHEN hyp_id % 2 = 0 THEN 80.5 END AS median, CASE WHEN hyp_id % 3 = 0 THEN 70.25 END AS mean, CASE WHEN hyp_id % 5 <> 0 THEN 90.0 END AS pred, 'pH=' || CAST(hyp_id % 14 AS VARCHAR) || '.0' AS param FROM hyp),
n AS (SELECT *, coalesce(median, mean) AS base, CASE WHEN median IS NOT NULL THEN 'медиана k по архиву ' || printf('%.2f', median) WHEN mean IS NOT NULL THEN 'среднее k в источниках ' || printf('%.2f', mean) END AS note FROM x)
SELECT hyp_id, CASE WHEN base IS NOT NULL AND pred IS NOT NULL THEN 'Контрфактуал: при сохранении базового режима (' || note || ') прогноз k остаётся ~' || printf('%.2f', base) || '; при внедрении гипотезы (' || param || ') ML-модель даёт ' || printf('%.2f', pred) || ' (Δ ' || printf('%+.2f', pred - base) || '). Без изменений KPI по «raise recovery…» не достигается.'
 ELSE 'Контрфактуал: если НЕ менять ' || param || ', сохраняется текущий уровень k по задаче «raise recovery…»' || coalesce(' (' || note || ')', '') || ' без целевого прироста.' END AS text FROM n""",
)
def b06(spark: SparkSession, d: str) -> DataFrame:
    h, k = t.hypotheses(spark, d), F.col("hyp_id")
    return h.select("hyp_id", proposals.counterfactual_text(F.lit("raise recovery"), F.lit("k"), F.col("text"), F.when(k % 2 == 0, 80.5), F.when(k % 3 == 0, 70.25), F.when(k % 5 != 0, 90.0)).alias("text"))


@query(
    "b09_step_resources",
    "WITH " + t.HYPOTHESES + """, s AS (SELECT hyp_id, unnest(roadmap) AS step, unnest(range(1, len(roadmap) + 1)) AS n FROM hyp)
SELECT hyp_id, CAST(n AS INT) AS step_order, CASE WHEN contains(step, 'проба 1') THEN 'Лабораторная проверка;проба 1' ELSE 'пробы 1 кг;существующее лабораторное оборудование' END AS resources, 'Отсутствие статистически значимого эффекта vs контроль' AS failure FROM s""",
)
def b09(spark: SparkSession, d: str) -> DataFrame:
    return business.structured_roadmap(t.hypotheses(spark, d)).select("hyp_id", "step_order", F.array_join("resources", ";").alias("resources"), F.col("failure_criteria").alias("failure"))


@query(
    "b15_template_steps",
    "SELECT DISTINCT l_orderkey AS hyp_id, l_linenumber AS step_order, CASE WHEN l_linenumber % 2 = 0 THEN 'Оптимизация pH в заданном диапазоне' ELSE 'Химический и granulometric анализ' END AS title, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 5 END AS INT) AS days FROM lineitem WHERE l_linenumber <> 3",
)
def b15(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    wanted = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hyp_id"), n.alias("step_order"), F.when(n == 3, "none").when(n % 2 == 0, "ph_matrix").otherwise("analytics").alias("template")).distinct()
    return business.template_steps(wanted).select("hyp_id", "step_order", "title", F.col("duration_days").alias("days"))
