"""Queries over problems, contexts, citations and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import text as tx
from lithos.operators import business, chunking, citations, evaluation, feedback, graphs, hypotheses, judging, model, proposals, retrieval, tables
from lithos.sources import files
from lithos.sources import sql as stores

from . import record_queries as rec
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


@query(
    "t15_constraints",
    r"""WITH p AS (SELECT conv_id AS query_id, CASE conv_id % 3 WHEN 0 THEN 'raise yield of ' || role || chr(10) || 'Ограничения: turn ' || CAST(turn AS VARCHAR) WHEN 1 THEN 'raise yield of ' || role || '. Constraints: turn ' || CAST(turn AS VARCHAR) ELSE 'raise yield of ' || role END AS x, turn, role FROM conversations)
SELECT query_id, turn, 'raise yield of ' || role AS problem, CASE WHEN query_id % 3 < 2 THEN 'turn ' || CAST(turn AS VARCHAR) ELSE '' END AS constraints FROM p""",
)
def t15(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "conversations")
    tail = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    text = F.concat(F.lit("raise yield of "), "role")
    p = F.when(F.col("conv_id") % 3 == 0, F.concat(text, F.lit("\nОграничения: "), tail)).when(F.col("conv_id") % 3 == 1, F.concat(text, F.lit(". Constraints: "), tail)).otherwise(text)
    return proposals.split_constraints(c.select(F.col("conv_id").alias("query_id"), "turn", p.alias("problem"), F.lit("").alias("constraints")))


@query("t17_measurable", r"SELECT doc_id, regexp_matches(text, '[0-9]+[.,]?[0-9]*\s*%') AS percent FROM documents")
def t17(spark: SparkSession, d: str) -> DataFrame:
    return t.documents(spark, d).select("doc_id", tx.is_measurable(F.col("text"), (r"[0-9]+[.,]?[0-9]*\s*%",)).alias("percent"))


@query("t18_intervention", "WITH " + t.HYPOTHESES + " SELECT hyp_id, hyp_id % 3 = 0 AS intervention FROM hyp")
def t18(spark: SparkSession, d: str) -> DataFrame:
    return t.hypotheses(spark, d).select("hyp_id", tx.is_intervention(F.col("text")).alias("intervention"))


@query("t19_metadata", "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_custkey AS VARCHAR) AS ph, ['Clerk ' || o_orderpriority] AS authors, CASE WHEN o_orderkey % 2 = 0 THEN 'руда' END AS material, 'S' || CAST(o_orderkey AS VARCHAR) AS sample_id FROM orders")
def t19(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders")
    text = F.concat(F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nAuthor: Clerk "), "o_orderpriority", F.lit("\npH "), F.col("o_custkey").cast("string"), F.lit("\nSample #S"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("\nруда")).otherwise(F.lit("")))
    m = o.select(F.col("o_orderkey").alias("doc_id"), proposals.metadata(text).alias("m"))
    return m.select("doc_id", "m.date", F.col("m.pH").alias("ph"), "m.authors", "m.material", "m.sample_id")


@query("t21_process_uri", "SELECT p_partkey, 'allotrope:process/flotation/' || replace(p_type, ' ', '-') || '-laboratory-assay' AS uri FROM part")
def t21(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "part").select("p_partkey", proposals.process_uri(F.col("p_type")).alias("uri"))


@query("t30_parse_number", r"SELECT doc_id, CAST(nullif(regexp_extract(replace(text, ',', '.'), '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS number FROM documents")
def t30(spark: SparkSession, d: str) -> DataFrame:
    return t.documents(spark, d).select("doc_id", tx.parse_number(F.col("text")).alias("number"))


@query("t31_clean_id", r"SELECT doc_id, substr(" + tq.STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')") + ", 1, 60) AS id FROM documents")
def t31(spark: SparkSession, d: str) -> DataFrame:
    return t.documents(spark, d).select("doc_id", tx.clean_id(F.col("text")).alias("id"))


@query("t32_context", "SELECT conv_id AS query_id, md5(string_agg('[' || CAST(turn AS VARCHAR) || '] ' || role || ' (0.50)' || chr(10) || substr(text, 1, 900), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def t32(spark: SparkSession, d: str) -> DataFrame:
    hits = t.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("doc_id"), F.lit(0.5).alias("score"), "text")
    return proposals.context(hits).select("query_id", F.md5("context").alias("digest"))


@query("t33_prompts")
def t33(spark: SparkSession, d: str) -> DataFrame:
    hits = t.table(spark, d, "conversations").filter("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("doc_id"), F.lit(0.5).alias("score"), "text")
    asked = tq.problems(spark, d)
    hints = retrieval.case_hints(retrieval.route_cases(asked, tq.cases(spark), ["os "]), tq.cases(spark))
    return proposals.prompts(asked, proposals.context(hits), hints)


@query("t08_distinct_topics", "SELECT lang AS doc_id, min(doc_id) AS first_at FROM documents GROUP BY lang, lower(substr(text, 1, 40))")
def t08(spark: SparkSession, d: str) -> DataFrame:
    topics = t.documents(spark, d).select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("at"), F.substring("text", 1, 40).alias("topic"))
    return evaluation.distinct_topics(topics).select("doc_id", F.col("at").alias("first_at"))


@query("t27_guess_label", "WITH e AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size > 25) SELECT p_partkey, CASE WHEN p_type IN (SELECT name FROM e) THEN 'Known' WHEN contains(p_type, 'PLATED') THEN 'Parameter' ELSE 'Parameter' END AS label FROM part")
def t27(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "part")
    known = p.filter("p_size > 25").select(F.col("p_type").alias("name"), F.lit("Known").alias("label")).distinct()
    return graphs.guess_label(p.select("p_partkey", F.col("p_type").alias("name")), known).select("p_partkey", "label")


@query("r05_chunk_lookup", "SELECT e.label AS doc_id, CAST(e.vec_id AS INT) AS chunk_index, 0.0::DOUBLE AS score FROM embeddings e WHERE vec_id % 3 = 0")
def r05(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").cast("int").alias("chunk_index"), F.lit("x").alias("text"))
    return retrieval.lookup(e, e.filter("chunk_index % 3 = 0").select("doc_id", "chunk_index")).select("doc_id", "chunk_index", "score")


def file_name() -> Column:
    k = F.col("doc_id") % 5
    return F.when(k == 0, F.lit("Brainstorm.docx")).when(k == 1, F.lit("dir/tailings.xlsx")).otherwise(F.lit("other.pdf"))


@query("r15_mandatory", "SELECT lang AS query_id, doc_id, CASE WHEN doc_id % 5 = 1 THEN 'kpi' ELSE 'brainstorm' END AS kind FROM documents WHERE doc_id % 5 = 0 OR (doc_id % 5 = 1 AND doc_id % 2 = 0)")
def r15(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d).select(F.col("lang").alias("query_id"), "doc_id", file_name().alias("source"), F.lit("").alias("title"), "text")
    lines = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("at"), F.lit("- line").alias("line"))
    return proposals.mandatory(docs, lines).select("query_id", "doc_id", "kind")


def with_vector(spark: SparkSession, d: str, df: DataFrame, key: Column) -> DataFrame:
    """df with vec_id: the vector that key chooses, as the tables have fewer vectors than chunks or hypotheses."""
    ends = t.table(spark, d, "embeddings").agg(F.min("vec_id").alias("__lo"), (F.max("vec_id") - F.min("vec_id") + 1).alias("__span"))
    return df.join(F.broadcast(ends), F.lit(True)).withColumn("vec_id", F.col("__lo") + F.pmod(key, F.col("__span"))).drop("__lo", "__span")


@query("r17_retrieve")
def r17(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of all documents: a chunk has the vector that its hash chooses, a query that of its number. Documents are
    files of the case folder that their source chooses, named as in R15."""
    e = t.table(spark, d, "embeddings")
    folder = F.concat(F.lit("dir"), F.pmod(F.xxhash64("source"), F.lit(3)).cast("string"))
    owned = t.documents(spark, d).select(folder.alias("query_id"), "doc_id", F.concat_ws("/", folder, file_name()).alias("source"), F.lit("").alias("title"), "text")
    chunks = with_vector(spark, d, chunking.chunks(owned.select("doc_id", "source", "text")), F.xxhash64("doc_id", "chunk_index"))
    problems, cases = tq.problems(spark, d), tq.cases(spark)
    routes = retrieval.route_cases(problems, cases, ["os "])
    dirs = routes.groupBy("query_id").agg(F.sort_array(F.collect_set("dir")).alias("dirs"))
    asked = with_vector(spark, d, problems, F.col("query_id"))
    asked = asked.join(e.select("vec_id", F.col("embedding").alias("query_vector")), "vec_id").drop("vec_id")
    asked = asked.join(dirs, "query_id", "left").withColumn("dirs", F.coalesce("dirs", F.array().cast("array<string>")))
    lines = owned.filter(F.col("source").endswith(".xlsx")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    brought = proposals.mandatory(owned, lines).withColumnRenamed("query_id", "dir")
    extra = proposals.case_extras(routes, brought)
    return proposals.retrieve(chunks, e.select("vec_id", "embedding"), asked, extra).select("query_id", "doc_id", "chunk_index", "rank")


@query(
    "r18_keyword_aliases",
    """WITH a AS (SELECT * FROM (VALUES ('tion', 'ending'), ('der', 'article')) v(term, alias)), w AS (SELECT conv_id AS query_id, unnest(k) AS word, generate_subscripts(k, 1) - 1 AS pos FROM (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[а-яёa-z]{5,}')) AS z, list_filter(regexp_extract_all(lower(text), '[а-яёa-z]{5,}'), lambda x, i: list_position(regexp_extract_all(lower(text), '[а-яёa-z]{5,}'), x) = i)[1:12] AS k FROM conversations WHERE turn = 0)),
u AS (SELECT query_id, pos, 0 AS side, word FROM w UNION ALL SELECT query_id, pos, 1, alias FROM w JOIN a ON contains(word, term) OR contains(term, word)), o AS (SELECT query_id, word, min(pos * 2 + side) AS k FROM u GROUP BY ALL), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INT) AS rank, word FROM o) SELECT * FROM r WHERE rank <= 20""",
)
def r18(spark: SparkSession, d: str) -> DataFrame:
    words = tq.problems(spark, d).select("query_id", F.posexplode(tx.problem_keywords(F.col("problem"), F.col("constraints"))).alias("at", "word"))
    return retrieval.expand_keywords(words, spark.createDataFrame([(0, "tion", "ending"), (1, "der", "article")], "place int, term string, alias string"))


@query("r20_corpus_graph", "SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS publication, 'tion=' || lang AS node, 'CITED_BY' AS type FROM documents WHERE contains(lower(substr(text, 1, 800)), 'tion') ORDER BY 1, 2 LIMIT 24")
def r20(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    return proposals.corpus_graph(docs, docs.select("doc_id", F.lit("tion").alias("key"), F.col("lang").alias("value")), ["TION"])


CITED = "ci AS (SELECT o_orderkey AS hyp_id, CASE o_orderkey % 4 WHEN 0 THEN 'src' || CAST(o_custkey % 25 AS VARCHAR) WHEN 1 THEN 'x-src' || CAST(o_custkey % 25 AS VARCHAR) || '-y' ELSE 'zzz' END AS cited_id FROM orders)"


def cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = t.table(spark, d, "orders")
    src = F.concat(F.lit("src"), (F.col("o_custkey") % 25).cast("string"))
    c = o.select(F.col("o_orderkey").alias("hyp_id"), F.col("o_orderkey").alias("citation_id"), F.lit("q").alias("query_id"), F.lit(0).alias("at"), F.when(F.col("o_orderkey") % 4 == 0, src).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("x-"), src, F.lit("-y"))).otherwise(F.lit("zzz")).alias("cited_id"), F.lit("").alias("snippet"))
    hits = t.documents(spark, d).groupBy(F.col("source").alias("doc_id")).agg(F.min("doc_id").alias("rank"), F.min("text").alias("text")).withColumn("query_id", F.lit("q"))
    return c, hits


@query("c09_resolve_ids", "WITH " + CITED + ", s AS (SELECT source AS doc_id, min(doc_id) AS rank FROM documents GROUP BY 1), n AS (SELECT hyp_id, arg_min(doc_id, rank) AS near FROM ci JOIN s ON contains(s.doc_id, cited_id) OR contains(cited_id, s.doc_id) GROUP BY 1) SELECT ci.hyp_id AS citation_id, CASE WHEN cited_id IN (SELECT doc_id FROM s) THEN cited_id ELSE near END AS resolved FROM ci LEFT JOIN n USING (hyp_id)")
def c09(spark: SparkSession, d: str) -> DataFrame:
    return citations.resolve_doc_ids(*cited(spark, d)).select("citation_id", "resolved")


@query("c10_clean_sources")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.clean_sources(*cited(spark, d)).select("hyp_id", "doc_id", F.md5("snippet").alias("digest"))


@query("c11_grounding", "WITH " + tq.PLANTED + ", o AS (SELECT item_id, doc_id, len(list_intersect(" + tq.TOKENS.format("snippet") + ", " + tq.TOKENS.format("corpus") + ")) / len(" + tq.TOKENS.format("snippet") + ") AS ov, contains(" + tq.FORM.format("corpus") + ", " + tq.FORM.format("snippet") + ") AS whole FROM pl) SELECT item_id AS hyp_id, count(*) FILTER (whole) > 0 AS exact FROM o GROUP BY 1")
def c11(spark: SparkSession, d: str) -> DataFrame:
    p = tq.planted(spark, d)
    g = citations.grounding(p.select(F.col("item_id").alias("hyp_id"), F.concat_ws("-", "item_id", "doc_id").alias("doc_id"), "snippet"), p.select(F.concat_ws("-", "item_id", "doc_id").alias("doc_id"), "corpus"), least=1.0)
    return g.select("hyp_id", F.col("source_grounded").alias("exact"))


@query("h02_sanitize", "WITH " + t.HYPOTHESES + " SELECT hyp_id, length(mechanism) >= 10 AND has_source AS strict, CASE WHEN length(mechanism) >= 10 THEN mechanism ELSE 'Предполагаемое влияние параметров процесса на целевой показатель' END AS mechanism FROM hyp")
def h02(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses.sanitized(t.hypotheses(spark, d)).select("hyp_id", "strict", "mechanism")


@query("h07_numbered", "SELECT o_orderkey AS sample_no, substr('run-' || CAST(o_custkey % 25 AS VARCHAR), 1, 8) || '-h' || CAST(row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) - 1 AS VARCHAR) AS hyp_id FROM orders")
def h07(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders").select(F.concat(F.lit("run-"), (F.col("o_custkey") % 25).cast("string")).alias("run_id"), F.col("o_orderkey").alias("sample_no"), F.lit(0).alias("at"))
    return hypotheses.numbered(o).select("sample_no", "hyp_id")


@query("h08_repair", rec.WITH_VERDICT + " SELECT hyp_id, CASE WHEN NOT approved AND hyp_id % 10 = 0 THEN 'new' ELSE mechanism END AS mechanism FROM va JOIN hyp USING (hyp_id)")
def h08(spark: SparkSession, d: str) -> DataFrame:
    v = rec.verdicts(spark, d)
    repairs = v.filter("hyp_id % 10 = 0").select("hyp_id", F.lit("new").alias("mechanism"))
    return hypotheses.repaired(v.select("hyp_id", "mechanism", "approved"), repairs, ("mechanism",)).select("hyp_id", "mechanism")


@query("h11_equipment", "SELECT p_partkey AS hyp_id, CAST(0 AS INT) AS place, 'ring' AS equipment FROM part WHERE contains(p_name, 'ring') UNION ALL SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END, 'red' FROM part WHERE contains(p_name, 'red')")
def h11(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "part").select(F.col("p_partkey").alias("hyp_id"), F.col("p_name").alias("text"))
    return graphs.equipment(p, (("RING", "ring"), ("RED", "red"))).select("hyp_id", F.col("at").alias("place"), "equipment")


@query("h12_default_graph", "WITH " + t.HYPOTHESES + " SELECT hyp_id, CAST(2 AS BIGINT) AS nodes FROM hyp")
def h12(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = proposals.default_graph(t.hypotheses(spark, d), F.lit("recovery of metal"))
    return nodes.groupBy("hyp_id").agg(F.count("*").alias("nodes")).join(links.select("hyp_id").distinct(), "hyp_id", "left_semi")


@query("h17_entities", "WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, 'part=' || CAST(l_partkey AS VARCHAR) AS a FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS doc_id, 'mode=' || l_returnflag AS b FROM lineitem) SELECT doc_id, a AS source, b AS target, 'MODIFIES' AS type FROM m JOIN p USING (doc_id)")
def h17(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem")
    m = li.select(F.col("l_orderkey").alias("doc_id"), F.lit("part").alias("key"), F.lit("parameter").alias("kind"), F.col("l_partkey").cast("string").alias("value")).union(li.select("l_orderkey", F.lit("mode"), F.lit("process"), "l_returnflag"))
    return proposals.entities(m)[1]


@query("h18_merge_extracted", "SELECT l_orderkey AS doc_id, lower(l_linestatus) AS name, min(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END) AS origin FROM lineitem GROUP BY 1, 2")
def h18(spark: SparkSession, d: str) -> DataFrame:
    li = t.table(spark, d, "lineitem")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_linestatus")).otherwise(F.col("l_linestatus"))
    parts = li.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(1).alias("origin"), F.col("l_linenumber").alias("at"), name.alias("name"))
    return graphs.merge_extracted(parts).select("doc_id", F.lower("name").alias("name"), "origin")


@query("h19_pipeline")
def h19(spark: SparkSession, d: str) -> DataFrame:
    reviews = t.reviews(spark, d).withColumn("hyp_id", F.concat((F.col("hyp_id") % 25).cast("string"), F.lit("-h"), F.floor(F.col("hyp_id") / 25).cast("string"))).dropDuplicates(["hyp_id"])
    return proposals.propose(rec.samples(spark, d), reviews, F.lit("recovery"), ()).select("hyp_id", "run_id", "rank", "approved", F.round("overall_score", 4).alias("overall_score"))


@query("j20_rationale", rec.WITH_VERDICT + " SELECT hyp_id, CAST(4 AS INT) AS lines, CASE WHEN approved THEN 'Одобрено' ELSE 'Отклонено' END AS head FROM va")
def j20(spark: SparkSession, d: str) -> DataFrame:
    r = judging.rationale(rec.verdicts(spark, d).withColumn("issues", F.lit(None).cast("array<string>")))
    return r.select("hyp_id", F.size("rationale").alias("lines"), F.get("rationale", 0).alias("head"))


@query("b05_analogies")
def b05(spark: SparkSession, d: str) -> DataFrame:
    """Every hypothesis asks with the vector of its number; its hits are the 12 chunks that R01 finds nearest."""
    e = t.table(spark, d, "embeddings")
    h = with_vector(spark, d, t.hypotheses(spark, d).select("hyp_id", F.col("mechanism").alias("text")), F.col("hyp_id")).withColumnRenamed("vec_id", "query_id")
    asked = e.join(h.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = retrieval.vector_top_k(e.select("vec_id", "embedding"), asked, 12).drop("rank")
    chunks = with_vector(spark, d, chunking.chunks(t.documents(spark, d).select("doc_id", "text")), F.xxhash64("doc_id", "chunk_index"))
    order = [F.desc("score"), F.asc("vec_id"), F.asc("doc_id"), F.asc("chunk_index")]
    places = retrieval.ranked(near.join(chunks.drop("text"), "vec_id"), ["query_id"], order, 12)
    hits = places.join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    return proposals.analogies(h, hits)


def asked_hypotheses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = t.hypotheses(spark, d).select("hyp_id", F.col("run_id").alias("query_id"), "text")
    hits = h.filter("hyp_id % 50 = 1").select("query_id", F.floor(F.col("hyp_id") / 50).alias("rank"), F.concat(F.lit("yield: "), (F.col("hyp_id") % 30).cast("string")).alias("text"))
    return h, hits


@query("b06_counterfactual", "WITH " + t.HYPOTHESES + ", m AS (SELECT run_id AS query_id, avg(CAST(hyp_id % 30 AS DOUBLE)) AS b FROM hyp WHERE hyp_id % 50 = 1 AND hyp_id // 50 <= 10 GROUP BY 1) SELECT hyp_id, 'pH' AS parameter, round(b, 6) AS baseline, round(80 - b, 6) AS delta FROM hyp LEFT JOIN m ON query_id = run_id")
def b06(spark: SparkSession, d: str) -> DataFrame:
    h, hits = asked_hypotheses(spark, d)
    c = proposals.counterfactual(h.withColumns({"baseline": F.lit(None).cast("double"), "predicted": F.lit(80.0)}), hits)
    return c.select("hyp_id", "parameter", F.round("baseline", 6).alias("baseline"), F.round("delta", 6).alias("delta"))


@query("b07_analysis", "WITH " + t.HYPOTHESES + ", n AS (SELECT run_id, count(*) AS k FROM hyp WHERE hyp_id % 50 = 1 GROUP BY 1) SELECT hyp_id, CAST(round(greatest(0.15, least(0.85, 0.45 + 0.1 * coalesce(k, 0)) - 0.06), 3) AS DOUBLE) AS predictive FROM hyp LEFT JOIN n USING (run_id)")
def b07(spark: SparkSession, d: str) -> DataFrame:
    h, hits = asked_hypotheses(spark, d)
    gaps = h.select("query_id").distinct().withColumn("severity", F.lit("high"))
    stated = hits.withColumn("text", F.concat(F.lit("metric recovery 1, "), "text"))
    return proposals.analysis(h.withColumn("text", F.lit("recovery 5")), stated, gaps)


@query("b08_uncertainty", "WITH " + t.EVENTS + ", c AS (SELECT tenant, status, count(*) AS n FROM ev GROUP BY ALL), d AS (SELECT tenant, arg_max(status, n * 10 + CASE status WHEN 'confirmed' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END) AS dominant FROM c GROUP BY 1) SELECT tenant, dominant, round(avg(novelty), 9) AS predictive FROM ev JOIN d USING (tenant) GROUP BY ALL")
def b08(spark: SparkSession, d: str) -> DataFrame:
    e = t.events(spark, d).select(F.col("tenant").alias("run_id"), F.col("novelty").alias("predictive"), F.col("risk").alias("overall_score"), F.col("status").alias("confidence"))
    return business.uncertainty(e).select(F.col("run_id").alias("tenant"), "dominant", F.round("predictive", 9).alias("predictive"))


@query("b11_roadmap_lines", "WITH " + t.STEPS + " SELECT hyp_id, step_order, 'Шаг ' || CAST(step_order AS VARCHAR) || ': step ' || CAST(step_order AS VARCHAR) || ' (' || CAST(duration_days AS VARCHAR) || ' дн.)' AS line FROM st")
def b11(spark: SparkSession, d: str) -> DataFrame:
    return business.roadmap_lines(t.steps(spark, d))


@query("f09_patch", "SELECT unnest(['novelty', 'feasibility', 'expected_value', 'risk']) AS criterion, unnest([n / (n + 0.7), 0.25 / (n + 0.7), 0.3 / (n + 0.7), 0.15 / (n + 0.7)]) AS weight FROM (SELECT round(avg(value) / 1000, 3) AS n FROM events)")
def f09(spark: SparkSession, d: str) -> DataFrame:
    patch = t.table(spark, d, "events").agg(F.round(F.avg("value") / 1000, 3).alias("weight")).select(F.lit("novelty").alias("criterion"), "weight")
    own = spark.createDataFrame([("novelty", 0.3), ("feasibility", 0.25), ("expected_value", 0.3), ("risk", 0.15)], "criterion string, weight double")
    return feedback.patch_weights(own, patch)


@query("f01_criterion_scores", "WITH " + t.HYPOTHESES + " SELECT hyp_id, unnest(['novelty', 'feasibility', 'expected_value', 'risk']) AS criterion, unnest([novelty, feasibility, expected_value, (risk_technical + risk_economic) / 2]) AS score FROM hyp")
def f01(spark: SparkSession, d: str) -> DataFrame:
    h = t.hypotheses(spark, d).select("hyp_id", *feedback.CRITERIA[:3], "risk_technical", "risk_economic")
    return feedback.criterion_scores(h)


@query("l04_features", "WITH " + t.HYPOTHESES + " SELECT hyp_id, CAST(hyp_id % 14 AS DOUBLE) AS ph, CAST(25 AS DOUBLE) AS temperature FROM hyp")
def l04(spark: SparkSession, d: str) -> DataFrame:
    f = model.text_features(F.col("text"), ["ph", "temperature"])
    return t.hypotheses(spark, d).select("hyp_id", f.alias("f")).select("hyp_id", F.get("f", 0).alias("ph"), F.get("f", 1).alias("temperature"))


@query("l06_label", "SELECT 'Ridge (l_extendedprice ~ l_quantity, l_tax)' AS label, round(median(l_extendedprice), 4) AS baseline FROM lineitem")
def l06(spark: SparkSession, d: str) -> DataFrame:
    m = model.ridge(t.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])
    return model.model_label(m).select("label", F.round("baseline", 4).alias("baseline"))


@query("v05_retrieval_hit", "WITH h AS (SELECT DISTINCT lang AS case_id, source AS got FROM documents), c AS (SELECT lang AS case_id, doc_id, 'src' || CAST(doc_id % 40 AS VARCHAR) AS want FROM documents), g AS (SELECT case_id || CAST(doc_id AS VARCHAR) AS k, case_id, want FROM c) SELECT k AS case_id, (SELECT bool_or(contains(got, want)) FROM h WHERE h.case_id = g.case_id) AS hit FROM g")
def v05(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    key = F.concat("lang", F.col("doc_id").cast("string"))
    cases = docs.select(key.alias("case_id"), "lang", F.concat(F.lit("src"), (F.col("doc_id") % 40).cast("string")).alias("doc_id"))
    hits = docs.select("lang", F.col("source").alias("doc_id")).distinct()  # those of a language, for all its cases
    return evaluation.retrieval_hit(cases, hits, "lang")


@query("v06_citation_support", "WITH w AS (SELECT lang AS run_id, list_filter(regexp_extract_all(lower(text), '[а-яёa-z]{6,}'), lambda x, i: list_position(regexp_extract_all(lower(text), '[а-яёa-z]{6,}'), x) = i)[1:5] AS w, lower(substr(text, 200, 200)) AS s FROM documents) SELECT run_id, round(avg(CAST(len(list_filter(w, lambda x: contains(s, x))) > 0 AS INT)), 3) AS support FROM w GROUP BY 1")
def v06(spark: SparkSession, d: str) -> DataFrame:
    h = t.documents(spark, d).select(F.col("lang").alias("run_id"), "text", F.substring("text", 200, 200).alias("snippet"))
    return evaluation.citation_support(h)


@query("v11_readiness", "SELECT 'vectors' AS name, count(*) AS n, CASE WHEN count(*) < 10 THEN 'под порогом: vectors' ELSE 'ok' END AS state FROM embeddings UNION ALL SELECT 'nodes', count(*), CASE WHEN count(*) < 1 THEN 'под порогом: nodes' ELSE 'ok' END FROM supplier UNION ALL SELECT 'chunks', count(*), CASE WHEN count(*) < 3 THEN 'под порогом: chunks' ELSE 'ok' END FROM benchmark")
def v11(spark: SparkSession, d: str) -> DataFrame:
    n = lambda table, name: t.table(spark, d, table).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return evaluation.readiness(n("embeddings", "vectors").union(n("supplier", "nodes")).union(n("benchmark", "chunks")))


@query("k04_labels", "WITH " + t.SHEETS + r", c AS (SELECT sheet, row_idx, unnest([c0, c1, c2, c3]) AS c FROM sh) SELECT sheet, row_idx, count(*) FILTER (length(c) >= 2 AND regexp_matches(c, '[а-яёa-zA-Z]'))::INT AS labels FROM c GROUP BY ALL")
def k04(spark: SparkSession, d: str) -> DataFrame:
    return t.sheets(spark, d).select("sheet", "row_idx", F.size(tables.labels(F.col("cells"))).alias("labels"))


@query("k06_size_class", "WITH " + t.SHEETS + r" SELECT sheet, row_idx, CASE WHEN regexp_matches(c1, '^[+]\d') THEN c1 ELSE c2 END AS label FROM sh")
def k06(spark: SparkSession, d: str) -> DataFrame:
    return t.sheets(spark, d).select("sheet", "row_idx", tables.grain(F.col("cells"))["label"].alias("label"))


@query("k22_experiment_text")
def k22(spark: SparkSession, d: str) -> DataFrame:
    e = tables.experiment_rows(rec.experiments(spark, d), most=1 << 30)
    return e.select("sheet", "row_idx", F.md5(tables.experiment_text(F.concat("sheet", F.lit(".xlsx")))).alias("digest"), tables.experiment_id(F.col("sheet")).alias("id"))


@query("s04_assemble", "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN 'T' ELSE '' END, ''), list_extract(string_split(url, '/'), -1)) AS title FROM pages")
def s04(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 2 == 0, F.lit("T")).otherwise(F.lit("")).alias("title"))
    return files.assemble(p).select("page_id", "title")


@query("s13_sql_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 500")
def s13(spark: SparkSession, d: str) -> DataFrame:
    t.table(spark, d, "orders").createOrReplaceTempView("lithos_orders")
    return stores.sql_rows(spark, "SELECT o_orderkey, o_totalprice FROM lithos_orders WHERE o_totalprice > 1000 ORDER BY o_orderkey")


@query("s18_point_count", "SELECT count(*) AS n FROM embeddings")
def s18(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "embeddings").agg(F.count("*").alias("n"))


@query("s19_publications", "SELECT source AS id, max(doc_id) AS version FROM documents GROUP BY 1")
def s19(spark: SparkSession, d: str) -> DataFrame:
    return stores.upsert(t.documents(spark, d).select(F.col("source").alias("id"), F.col("doc_id").alias("version")), ["id"], "version")
