"""Queries over what is kept: feedback event by event, its stream, keyed tables and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.operators import chunking, evaluation, judging, learning, lineage, proposals, retrieval, runs
from lithos.operators.feedback import CRITERIA
from lithos.sources import sql as sources
from lithos.sources import stores
from lithos.streaming import flows

from . import case_queries as cq
from . import proposal_queries as pq
from . import tables as t
from . import text_queries as tq

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_HEAD = f"substr(e.text, 1, {learning.HEAD})"
LISTS = t.EVENTS + f""", e AS (SELECT tenant, status, substr(text, 1, 220) AS text, row_number() OVER (PARTITION BY tenant, status ORDER BY ts, event_id) AS k FROM ev WHERE status <> 'needs_review'),
l AS (SELECT tenant, status, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(text VARCHAR, n BIGINT)[]) AS items FROM (SELECT DISTINCT tenant, status FROM e)
UNION ALL SELECT l.tenant, l.status, e.k, CASE WHEN list_contains(list_transform(items, lambda i: substr(i.text, 1, {learning.HEAD})), {_HEAD})
 THEN list_transform(items, lambda i: struct_pack(text := i.text, n := i.n + CASE WHEN substr(i.text, 1, {learning.HEAD}) = {_HEAD} THEN 1 ELSE 0 END))
 ELSE list_prepend(struct_pack(text := e.text, n := CAST(1 AS BIGINT)), items)[1:{learning.KEEP}] END FROM l JOIN e ON e.tenant = l.tenant AND e.status = l.status AND e.k = l.k + 1),
f AS (SELECT tenant, status, arg_max(items, k) AS items FROM l GROUP BY ALL)"""


@query("f05_exact_lists", "WITH RECURSIVE " + LISTS + " SELECT tenant, status, CAST(rank AS INT) AS rank, i.text AS text, i.n AS n FROM (SELECT tenant, status, unnest(items) AS i, generate_subscripts(items, 1) AS rank FROM f)")
def f05(spark: SparkSession, d: str) -> DataFrame:
    """Exemplars and anti-patterns of each tenant, in the order in which they came."""
    return learning.listed(learning.learned(t.events(spark, d))).drop("note")


def _weights() -> str:
    """The weights after each event: F07's step, then F08's by the averages up to here."""
    means = ", ".join(f"avg({c}) FILTER (WHERE status = 'confirmed') OVER w AS c_{c}, avg({c}) FILTER (WHERE status <> 'confirmed') OVER w AS r_{c}" for c in CRITERIA)
    begin = ", ".join(f"CAST({lx.RANKING_WEIGHTS[c]} AS DOUBLE) AS {c}" for c in CRITERIA)
    total = " + ".join(f"a_{c}" for c in CRITERIA)
    step = ", ".join(f"CASE WHEN o.{c} >= 7 AND o.status = 'confirmed' THEN least(g.{c} + 0.02, 0.5) WHEN o.{c} >= 7 THEN greatest(g.{c} - 0.01, 0.05) ELSE g.{c} END AS a_{c}" for c in CRITERIA)
    evened = ", ".join(f"a_{c} / ({total}) AS b_{c}" for c in CRITERIA)
    both = f"coalesce({', '.join(f'c_{c}' for c in CRITERIA)}) IS NOT NULL AND coalesce({', '.join(f'r_{c}' for c in CRITERIA)}) IS NOT NULL"
    gap = ", ".join(f"CASE WHEN {both} AND abs((c_{c} - r_{c}) / 10) > {learning.LEAST_GAP} THEN greatest(0.05, least(0.5, b_{c} + 0.05 * ((c_{c} - r_{c}) / 10))) ELSE b_{c} END AS d_{c}" for c in CRITERIA)
    last = " + ".join(f"d_{c}" for c in CRITERIA)
    out = ", ".join(f"d_{c} / ({last})" for c in CRITERIA)
    carried = ", ".join(f"c_{c}, r_{c}" for c in CRITERIA)
    return f""", o AS (SELECT *, row_number() OVER w AS k, {means} FROM ev WINDOW w AS (PARTITION BY tenant ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT DISTINCT tenant, CAST(0 AS BIGINT) AS k, {begin} FROM ev
UNION ALL SELECT tenant, k, {out} FROM (SELECT tenant, k, {gap} FROM (SELECT tenant, k, {carried}, {evened} FROM (SELECT o.tenant, o.k, {carried}, {step} FROM g JOIN o ON o.tenant = g.tenant AND o.k = g.k + 1)))),
v AS (SELECT tenant, max(k) AS n, {', '.join(f'round(arg_max({c}, k), 6) AS {c}' for c in CRITERIA)} FROM g GROUP BY 1),
p AS (SELECT tenant, count(*) FILTER (WHERE status = 'confirmed') AS confirmed_count, count(*) FILTER (WHERE status = 'rejected') AS rejected_count, coalesce(sum(risk) FILTER (WHERE status <> 'confirmed'), 0) AS rejected_risk_total FROM ev GROUP BY 1)"""


STATES = "WITH RECURSIVE " + t.EVENTS + _weights() + " SELECT * FROM v JOIN p USING (tenant)"


def _states(df: DataFrame) -> DataFrame:
    return df.select("tenant", "n", *[F.round(c, 6).alias(c) for c in CRITERIA], "confirmed_count", "rejected_count", "rejected_risk_total")


@query("f08_learned_states", STATES)
def f08(spark: SparkSession, d: str) -> DataFrame:
    """What each tenant's events have taught: weights by F07 and F08 after every event, counters and profiles."""
    return _states(learning.learned(t.events(spark, d)))


@query("x02_feedback_stream", STATES)
def x02(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream with keyed state, over three files of events in the order of time."""
    events, folder = lineage.settled(t.events(spark, d)), lineage.fresh(spark, "feedback")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.agg(F.percentile_approx(at, [0.3, 0.7])).first()[0] or [0, 0]
    for part in (at <= bounds[0], (at > bounds[0]) & (at <= bounds[1]), at > bounds[1]):
        events.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        flows.learning_stream(stream, f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return _states(flows.current_states(spark, f"{folder}/states"))


@query("x01_ingest_stream")
def x01(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, which come in two files and a third that brings known ones again."""
    docs, folder = t.table(spark, d, "documents").select("doc_id", "text", "source"), lineage.fresh(spark, "ingest")
    for part in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1, F.col("doc_id") % 5 == 0):
        docs.filter(part).write.mode("append").parquet(f"{folder}/in")
        flows.ingest_stream(spark, f"{folder}/in", "doc_id long, text string, source string", f"{folder}/chunks", f"{folder}/checkpoint").awaitTermination()
    return stores.read(spark, f"{folder}/chunks", "bucket", "int").select("doc_id", "chunk_index", "text")


@query(
    "s17_vector_store",
    "SELECT vec_id, label, CAST(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, CASE WHEN vec_id % 3 = 0 THEN -label ELSE label END AS kept, (SELECT count(*) FROM embeddings) AS points FROM embeddings",
)
def s17(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as points of a collection, a third of them written again with another payload, and older ones after that."""
    own = t.table(spark, d, "embeddings").select(sources.point_key(F.col("vec_id"), F.lit(0)).alias("point"), "vec_id", "label", F.col("label").alias("kept"), "embedding")
    folder = lineage.fresh(spark, "points")
    stores.upsert_store(own.withColumn("version", F.lit(1).cast("long")), folder, ["point"], "version")
    again = own.filter("vec_id % 3 = 0").withColumn("kept", -F.col("label"))
    for version in (2, 0):
        stores.upsert_store(again.withColumn("version", F.lit(version).cast("long")), folder, ["point"], "version")
    n = stores.point_count(spark, folder)
    return stores.read(spark, folder, "bucket", "int").select("vec_id", "label", "version", "kept").crossJoin(n)  # one row


@query(
    "s06_processed_store",
    "SELECT doc_id AS id, md5(CASE WHEN doc_id % 4 = 0 THEN 'newer ' || text ELSE text END) AS digest, source FROM documents",
)
def s06(spark: SparkSession, d: str) -> DataFrame:
    """Processed documents by id; a newer text takes the place of an older one."""
    docs, folder = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source"), lineage.fresh(spark, "processed")
    stores.upsert_store(docs.withColumn("version", F.lit(1)), folder, ["id"], "version")
    stores.upsert_store(docs.filter("id % 4 = 0").withColumns({"text": F.concat(F.lit("newer "), "text"), "version": F.lit(2)}), folder, ["id"], "version")
    return stores.read(spark, folder, "bucket", "int").select("id", F.md5("text").alias("digest"), "source")


@query(
    "s22_run_store",
    "WITH " + t.HYPOTHESES + " SELECT run_id, hyp_id, CASE WHEN hyp_id % 10 = 3 THEN 'other ' || text ELSE text END AS text, count(*) OVER (PARTITION BY run_id) AS hypotheses, count(*) FILTER (WHERE hyp_id % 3 = 0) OVER (PARTITION BY run_id) AS approved FROM hyp",
)
def s22(spark: SparkSession, d: str) -> DataFrame:
    """Runs written as partitions, a tenth of their hypotheses replaced, all loaded again with the list of runs."""
    h = t.hypotheses(spark, d).select("run_id", "hyp_id", "text", (F.col("hyp_id") % 3 == 0).alias("approved"), F.col("hyp_id").alias("created_at"))
    folder = lineage.fresh(spark, "runs")
    stores.save_runs(h, folder)
    stores.replace_hypotheses(h.filter("hyp_id % 10 = 3").select("run_id", "hyp_id", F.concat(F.lit("other "), "text").alias("text")), folder)
    runs = stores.list_runs(spark, folder).select("run_id", "hypotheses", F.col("approved"))
    return stores.read(spark, folder, "run_id").select("run_id", "hyp_id", "text").join(runs, "run_id")


# ---- decisions -----------------------------------------------------------------------------------

JUDGED = t.HYPOTHESES + """, j AS (SELECT hyp_id, run_id, text, has_source, doc_id, snippet, hyp_id % 3 = 0 AS approved, hyp_id % 2 = 0 AS source_grounded, CAST(hyp_id % 10 AS DOUBLE) AS testability, CAST(hyp_id % 7 AS DOUBLE) AS evidence_quality, CAST(hyp_id % 9 AS DOUBLE) AS relevance,
 (hyp_id % 100) / 10 AS overall_score, 1 + hyp_id % 2 AS mandatory_passed, 50.0 * (1 + hyp_id % 2) AS compliance_pct FROM hyp)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses with verdicts by number: a third approved, half grounded, four kinds of issues."""
    k = F.col("hyp_id")
    none = F.array().cast("array<string>")
    issues = F.when(k % 4 == 1, F.array(F.lit("ТЗ: a"), F.lit("Источники: нет"))).when(k % 4 == 2, F.array(F.lit("x"), F.lit("y"))).when(k % 4 == 3, none)
    return t.hypotheses(spark, d).select(
        "hyp_id", "run_id", "text", "sources", (k % 3 == 0).alias("approved"), (k % 2 == 0).alias("source_grounded"), (k % 10).cast("double").alias("testability"), (k % 7).cast("double").alias("evidence_quality"),
        (k % 9).cast("double").alias("relevance"), (k % 100 / 10).alias("overall_score"), (1 + k % 2).alias("mandatory_passed"), F.lit(2).alias("mandatory_total"), (50.0 * (1 + k % 2)).alias("compliance_pct"), issues.alias("issues"),
    )


@query(
    "j20_decision_lines",
    "WITH " + JUDGED + """ SELECT hyp_id, CASE WHEN approved THEN
 CASE WHEN source_grounded THEN 'Цитата из источника подтверждена в RAG-контексте (пересечение ≥ 30%)|' ELSE '' END || 'Чеклист ТЗ: ' || CAST(mandatory_passed AS VARCHAR) || '/2 обязательных пунктов (' || printf('%.0f', compliance_pct) || '%)|✓ first|' || CASE WHEN hyp_id % 2 = 1 THEN '✓ second|' ELSE '' END
 || 'Оценки судьи: проверяемость ' || printf('%.1f', testability) || ', доказательства ' || printf('%.1f', evidence_quality) || ', релевантность ' || printf('%.1f', relevance) || ' (пороги ≥ 6.0)|Итоговый балл ' || printf('%.1f', overall_score) || '/10 (порог одобрения 6.5)'
 || CASE WHEN has_source THEN '|Опора на источник `' || doc_id || '`: «' || substr(trim(snippet), 1, 80) || '…»' ELSE '' END
WHEN hyp_id % 4 = 1 THEN 'Источники: нет' || CASE WHEN hyp_id % 2 = 0 THEN '|✗ second — why' ELSE '' END
WHEN hyp_id % 4 = 2 THEN 'x|y|✗ second — why' WHEN hyp_id % 2 = 0 THEN '✗ second — why' ELSE 'Гипотеза не прошла один или несколько критериев судьи (см. замечания)' END AS lines FROM j""",
)
def j20(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every decision; of two required checks the second fails for even numbers."""
    j = judged(spark, d)
    k = F.col("hyp_id")
    checks = j.select("hyp_id", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("first").alias("key"), F.lit(True).alias("passed")), F.struct(F.lit(1).alias("at"), F.lit("second").alias("key"), (k % 2 == 1).alias("passed")))).alias("c"))
    checks = checks.select("hyp_id", "c.*", F.lit(True).alias("required"), F.lit("why").alias("note"))
    return judging.decision_rationale(j, checks).select("hyp_id", F.array_join("rationale", "|").alias("lines"))


_INDEX = "100 * (0.5 * avg(CAST(approved AS INT)) + 0.35 * avg(overall_score) / 10 + 0.15 * avg(CAST(source_grounded AS INT)))"


@query(
    "j21_summary_notes",
    "WITH " + JUDGED + f""", r AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE approved) AS a, avg(compliance_pct) AS c, {_INDEX} AS i FROM j GROUP BY 1)
SELECT run_id, '★ JQI (по всем оценённым гипотезам): ' || printf('%.1f', i) || ' / 75|★ Одобрено судьёй: ' || CAST(a AS VARCHAR) || ' из ' || CAST(n AS VARCHAR) || ' (' || printf('%.0f', 100 * a / n) || '%)|★ Соответствие ТЗ кейса: ' || printf('%.0f', c) || '% обязательных пунктов'
 || CASE WHEN n > a THEN '|⚠ ' || CAST(n - a AS VARCHAR) || ' гипотез отклонены — требуют доработки экспертом' ELSE '' END || CASE WHEN a < 3 THEN '|⚠ Одобренных меньше целевого минимума (3)' ELSE '' END AS notes FROM r""",
)
def j21(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    return judging.summary_notes(judging.run_summary(j.drop("compliance_pct"), j)).select("run_id", F.array_join("notes", "|").alias("notes"))


@query(
    "c12_source_labels",
    "WITH " + t.HYPOTHESES + " SELECT hyp_id, CASE WHEN has_source THEN substr(doc_id, 1, 28) || CASE WHEN hyp_id % 4 = 1 THEN ' (✓ RAG)' ELSE ' (✗ нет в RAG)' END ELSE '—' END AS label FROM hyp",
)
def c12(spark: SparkSession, d: str) -> DataFrame:
    """The context holds the sources of one hypothesis of four."""
    h = t.hypotheses(spark, d).select("hyp_id", F.transform("sources", lambda s: s["doc_id"]).alias("doc_ids"))
    known = h.filter("hyp_id % 4 = 1").select("hyp_id", F.explode("doc_ids").alias("doc_id"))
    return judging.source_labels(h, known)


def _repairs_sql(passes: int) -> str:
    """As many passes, each as its own tables: the runs below the target that had a repair before, their repairs, and the rows after."""
    parts = [t.HYPOTHESES, "s0 AS (SELECT hyp_id, run_id, hyp_id % 10 AS x, 0 AS passes FROM hyp)", "g0 AS (SELECT DISTINCT run_id FROM s0)"]
    for n in range(passes):
        index = "100 * (0.5 * avg(CAST(x >= 6.5 AS INT)) + 0.35 * avg(x) / 10 + 0.15 * avg(CAST(x > 1 AS INT)))"
        parts += [
            f"o{n} AS (SELECT run_id FROM s{n} WHERE run_id IN (SELECT run_id FROM g{n}) GROUP BY 1 HAVING {index} < 75)",
            f"f{n} AS (SELECT hyp_id, run_id FROM s{n} WHERE run_id IN (SELECT run_id FROM o{n}) AND x < 6.5 AND hyp_id % 4 <> 0)",
            f"g{n + 1} AS (SELECT DISTINCT run_id FROM f{n})",
            f"s{n + 1} AS (SELECT hyp_id, run_id, x + CASE WHEN hyp_id IN (SELECT hyp_id FROM f{n}) THEN 3 ELSE 0 END AS x, CASE WHEN run_id IN (SELECT run_id FROM g{n + 1}) THEN {n + 1} ELSE passes END AS passes FROM s{n})",
        ]
    return "WITH " + ", ".join(parts) + f" SELECT hyp_id, CAST(x AS BIGINT) AS score, CAST(passes AS INT) AS passes FROM s{passes}"


@query("h08_repair_loop", _repairs_sql(3))
def h08(spark: SparkSession, d: str) -> DataFrame:
    """Scores by number; a repair adds 3 to what is not approved, but for one hypothesis of four."""
    own = t.hypotheses(spark, d).select("hyp_id", "run_id", (F.col("hyp_id") % 10).cast("string").alias("text"), "mechanism", "reasoning")
    x = F.col("text").cast("double")

    def judge(h: DataFrame) -> DataFrame:
        return h.withColumns({"overall_score": x, "approved": x >= 6.5, "source_grounded": x > 1})

    def repairs(rejected: DataFrame, n: int) -> DataFrame:
        none = F.lit(None).cast("string")
        return rejected.filter("hyp_id % 4 <> 0").select("hyp_id", (F.col("text").cast("long") + 3).cast("string").alias("text"), none.alias("mechanism"), none.alias("reasoning"))

    return judging.repair_loop(own, judge, repairs, passes=3).select("hyp_id", F.col("text").cast("long").alias("score"), "passes")


@query(
    "r19_query_subgraphs",
    "WITH " + t.GRAPH + """, q AS (SELECT n_nationkey AS query_id, lower(substr(n_name, 1, 3)) AS w FROM nation UNION SELECT n_nationkey, lower(right(n_name, 2)) FROM nation), h AS (SELECT DISTINCT query_id, id, name FROM nd JOIN q ON contains(lower(name), w)),
e AS (SELECT source AS id, target AS other, type FROM ed UNION ALL SELECT target, source, type FROM ed), r AS (SELECT query_id, h.id, name, other, type, row_number() OVER (PARTITION BY query_id ORDER BY h.id, other NULLS FIRST, type) AS rank FROM h LEFT JOIN e USING (id))
SELECT query_id, id, name, other, type, CAST(rank AS INT) AS rank FROM r WHERE rank <= 30""",
)
def r19(spark: SparkSession, d: str) -> DataFrame:
    """Every nation asks with the beginning and the end of its name."""
    n = t.table(spark, d, "nation")
    words = n.select(F.col("n_nationkey").alias("query_id"), F.explode(F.array(F.substring("n_name", 1, 3), F.right(F.col("n_name"), F.lit(2)))).alias("keyword"))
    return retrieval.subgraphs(*t.graph(spark, d), words)


def numbers(counts: DataFrame, block: int = 10_000) -> DataFrame:
    """(run_id, i) for i from 0 to k - 1 of each row (run_id, k), in as many tasks as there are blocks."""
    starts = counts.filter("k > 0").select("run_id", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1, F.lit(block))).alias("start"))
    return lineage.spread(starts, "run_id", "start").select("run_id", F.explode(F.sequence("start", F.least(F.col("start") + block, "k") - 1)).alias("i"))


def whole_run(spark: SparkSession, d: str, folder: str) -> dict[str, DataFrame]:
    """All chunks of all documents; 25 problems, each with a vector; a run's samples cite documents of its number, and reviews go by number."""
    e = t.table(spark, d, "embeddings")
    case = F.concat(F.lit("dir"), F.pmod(F.xxhash64("source"), F.lit(3)).cast("string"))
    owned = t.documents(spark, d).select(case.alias("query_id"), "doc_id", F.concat_ws("/", case, pq.file_name()).alias("source"), F.lit("").alias("title"), "text")
    chunks = lineage.settled(pq.with_vector(spark, d, chunking.chunks(owned.select("doc_id", "source", "text")), F.xxhash64("doc_id", "chunk_index")))
    lines = owned.filter(F.col("source").endswith(".xlsx")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    brought = proposals.mandatory(owned, lines).withColumnRenamed("query_id", "dir")
    problems, hits, samples = cq.proposal_inputs(spark, d)
    named = problems.withColumns({"problem": F.concat("problem", F.when(F.col("query_id").cast("int") % 3 == 0, " production").otherwise("")), "n": F.lit(5)})
    asked = pq.with_vector(spark, d, named, F.col("query_id").cast("long") * 7)
    asked = asked.join(e.select("vec_id", F.col("embedding").alias("query_vector")), "vec_id").drop("vec_id")
    ids = numbers(samples.groupBy("run_id").agg(F.count("raw").alias("k"))).select(F.concat("run_id", F.lit("-h"), F.col("i").cast("string")).alias("hyp_id"))
    # dealt out behind the numbering, as few rows come before it and Spark would send all that they become to the driver
    ids = lineage.spread(ids, "hyp_id")
    return runs.run(asked, chunks, e.select("vec_id", "embedding"), tq.cases(spark), brought, samples, cq.reviews_of(ids), folder, ["metal"])


@query("h19_stored_runs")
def h19(spark: SparkSession, d: str) -> DataFrame:
    """Whole runs from retrieval to the stored and ordered hypotheses."""
    out = whole_run(spark, d, lineage.fresh(spark, "runs"))
    return out["hypotheses"].select("run_id", "hyp_id", "rank", "approved", "source_grounded", F.round("objective", 4).alias("objective"))


@query(
    "v10_scenario_details",
    "WITH " + JUDGED + """ SELECT run_id AS scenario, hyp_id, approved, overall_score, CASE WHEN hyp_id % 2 = 0 THEN 'second' ELSE '' END AS failed, substr(text, 1, 100) AS text,
 CASE hyp_id % 4 WHEN 1 THEN 'ТЗ: a;Источники: нет' WHEN 2 THEN 'x;y' ELSE '' END AS issues FROM j""",
)
def v10(spark: SparkSession, d: str) -> DataFrame:
    """A run is a scenario; of two required checks the second fails for even numbers."""
    j = judged(spark, d)
    checks = j.select("hyp_id", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("first").alias("key"), F.lit(True).alias("passed")), F.struct(F.lit(1).alias("at"), F.lit("second").alias("key"), (F.col("hyp_id") % 2 == 1).alias("passed")))).alias("c"))
    found = evaluation.scenario_details(j.withColumnRenamed("run_id", "scenario"), checks.select("hyp_id", "c.*", F.lit(True).alias("required")))
    return found.drop("compliance_pct").withColumns({"failed": F.array_join("failed", ";"), "issues": F.array_join("issues", ";")})


@query(
    "r20_corpus_nodes",
    """WITH h AS (SELECT doc_id, lang, source FROM documents WHERE contains(lower(substr(text, 1, 800)), 'tion') OR contains(lower(source), 'tion') ORDER BY doc_id LIMIT 24),
e AS (SELECT doc_id, -2 AS place, 'doc:' || CAST(doc_id AS VARCHAR) AS id, 'Publication' AS type FROM h UNION ALL SELECT doc_id, 0, 'motion=' || lang, 'Parameter' FROM h UNION ALL SELECT doc_id, -1, 'KPI recovery ' || CAST(doc_id % 9 AS VARCHAR) || '%', 'Property' FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id, place) AS turn FROM e)
SELECT CAST(row_number() OVER (ORDER BY doc_id, place, id) AS INT) AS pos, id, type FROM f WHERE turn = 1 ORDER BY pos LIMIT 24""",
)
def r20(spark: SparkSession, d: str) -> DataFrame:
    """Every document has its language as a parameter that names the keyword, and a share by number; documents without the keyword in their text do not come in."""
    docs = t.documents(spark, d).withColumns({"title": F.col("doc_id").cast("string"), "tags": F.array().cast("array<string>")})
    met = docs.filter(F.lower(F.substring("text", 1, 800)).contains("tion") | F.lower("source").contains("tion"))
    own = met.select("doc_id", F.lit(0).alias("at"), F.lit("motion").alias("key"), F.col("lang").alias("value"), F.lit("process_parameters").alias("bucket"))
    shares = met.select("doc_id", F.lit(1).alias("at"), F.lit("recoverable_metal_pct").alias("key"), (F.col("doc_id") % 9).cast("string").alias("value"), F.lit("measurement_results").alias("bucket"))
    return proposals.whole_corpus_graph(docs, own.unionByName(shares), ["TION"])[0].select(F.col("at").alias("pos"), "id", "type")
