"""Queries over documents: cleaning, quality, chunks, keywords, overlap and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import text as tx
from lithos.operators import chunking, citations, evaluation, retrieval
from lithos.sources import files
from lithos.sources import sql as stores

from .tables import DOWN, STOP, TOPICS, UP, documents, heads, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


STRIP = r"regexp_replace({}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
QUALITY = (
    r"CASE WHEN length({0}) >= 20 THEN least(1.0, 0.5 * (len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}\s]')) / length({0}))"
    r" + 0.5 * least(len(regexp_extract_all({0}, '[а-яА-Яa-zA-Z]{{3,}}')) / greatest(length({0}) / 50, 1.0), 1.0)) ELSE 0.0 END"
)
HEADS = "hd AS (SELECT lang AS query_id, doc_id, 0 AS chunk_index, text, doc_id * 7919 % 1000 / 1000.0 AS score, doc_id AS rank, source FROM documents)"


@query("t01_normalize", r"SELECT doc_id, md5(" + STRIP.format(r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + ") AS digest FROM documents")
def t01(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"))


@query(
    "t02_ocr_clean",
    r"""WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(replace(text, chr(12), chr(10)), '[¦|]{2,}', ' ', 'g'), '[^\S\n]+', ' ', 'g'), chr(10)), lambda x: """ + STRIP.format("x") + r""") AS lines FROM documents)
SELECT doc_id, md5(""" + STRIP.format(r"array_to_string(list_filter(lines, lambda x: length(x) >= 2 AND (length(x) <= 10 OR len(regexp_extract_all(x, '[\p{L}\p{N}]')) / length(x) >= 0.25)), chr(10))") + ") AS digest FROM l",
)
def t02(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(tx.clean_ocr(F.col("text"))).alias("digest"))


@query("t03_text_quality", "SELECT doc_id, " + QUALITY.format("text") + " AS quality FROM documents")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.quality(F.col("text")).alias("quality"))


@query("t04_chunks")
def t04(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(documents(spark, d).select("doc_id", "text")).select("doc_id", "chunk_index", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("t05_doc_id", "SELECT doc_id, source || '_' || substr(sha256(substr(text, 1, 2000)), 1, 12) AS id FROM documents")
def t05(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.document_id(F.col("source"), F.col("text")).alias("id"))


@query("s15_sql_doc_id", r"SELECT doc_id, 'sql_' || substr(regexp_replace(source || ' ' || lang, '[^\p{L}\p{N}_\-]+', '_', 'g'), 1, 40) || '_' || substr(sha256(substr(text, 1, 1500)), 1, 12) AS id FROM documents")
def s15(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.sql_document_id(F.concat_ws(" ", "source", "lang"), F.col("text")).alias("id"))


@query("t10_needs_ocr", "SELECT doc_id, length(" + STRIP.format("text") + ") < 100 OR length(" + STRIP.format("text") + ") / (doc_id % 90 + 1) < 40 AS scan FROM documents")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.needs_ocr(F.col("text"), F.col("doc_id") % 90 + 1).alias("scan"))


@query(
    "t11_keywords",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[а-яА-Яa-zA-Z]{4,}')) AS word, generate_subscripts(regexp_extract_all(text, '[а-яА-Яa-zA-Z]{4,}'), 1) AS pos FROM documents),
f AS (SELECT doc_id, arg_min(word, pos) AS word, min(pos) AS pos FROM w GROUP BY doc_id, lower(word)),
r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM f) SELECT doc_id, CAST(place - 1 AS INT) AS place, word FROM r WHERE place <= 15""",
)
def t11(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(tx.keywords(F.col("text"))).alias("place", "word"))


@query(
    "t12_topic_labels",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[а-яёa-z]{6,}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[а-яёa-z]{6,}'), 1) AS pos FROM documents),
f AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w WHERE word NOT IN ('thation', 'ouement') GROUP BY ALL),
r AS (SELECT doc_id, word, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(word) DESC, pos) AS INT) AS rank FROM f) SELECT * FROM r WHERE rank <= 6""",
)
def t12(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.topic_labels(documents(spark, d), STOP)


@query(
    "t13_kpi_label",
    r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'tion') THEN 'endings' WHEN regexp_matches(lower(text), 'ß|é') THEN 'sharp' WHEN regexp_extract(lower(text), '[а-яёa-z]{6,}') <> '' THEN regexp_extract(lower(text), '[а-яёa-z]{6,}') ELSE 'none' END AS label FROM conversations""",
)
def t13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", tx.kpi_label(F.col("text"), (("endings", "tion"), ("sharp", "ß|é")), "none").alias("label"))


@query(
    "t14_kpi_markers",
    r"""WITH m AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[а-яёa-z]{5,}')[1:10], lambda w: length(w) > 5) AS w,
 CASE WHEN regexp_matches(lower(text), 'tion') THEN 'endings' WHEN regexp_extract(lower(text), '[а-яёa-z]{6,}') <> '' THEN regexp_extract(lower(text), '[а-яёa-z]{6,}') ELSE 'none' END AS label FROM conversations),
a AS (SELECT conv_id, turn, CASE WHEN label <> 'none' THEN list_append(w, label) ELSE w END AS w FROM m),
u AS (SELECT conv_id, turn, unnest(w) AS marker FROM a) SELECT DISTINCT conv_id, turn, marker FROM u""",
)
def t14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(tx.kpi_markers(F.col("text"), (("endings", "tion"),), "none")).alias("marker"))


@query("t22_overlap_form", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[\s\-—–]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def t22(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(tx.overlap_form(F.col("text"))).alias("digest"))


@query("t23_overlap_tokens", r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]{3,}'))) AS INT) AS tokens FROM documents")
def t23(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.size(tx.overlap_tokens(F.col("text"))).alias("tokens"))


@query("t24_dedupe_key", r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')), 1, 90) AS key FROM documents")
def t24(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.dedupe_key(F.col("text")).alias("key"))


@query("k15_kpi_chunks", "SELECT doc_id, CAST(CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'worthless') THEN 0.25 ELSE 0.0 END AS DOUBLE) AS boost FROM documents")
def k15(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", tx.kpi_boost(F.col("text"), ("license", "worthless")).alias("boost"))


@query(
    "k16_text_rows",
    """WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), 1) - 1 AS row_idx FROM documents),
c AS (SELECT doc_id, row_idx, list_transform(string_split(line, '|'), lambda x: """ + STRIP.format("x") + """) AS cells FROM l WHERE contains(line, '|'))
SELECT doc_id, CAST(row_idx AS INT) AS row_idx, CAST(len(cells) AS INT) AS n, array_to_string(cells, '|') AS cells FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0""",
)
def k16(spark: SparkSession, d: str) -> DataFrame:
    from lithos.operators import tables

    rows = tables.text_rows(documents(spark, d))
    return rows.select("doc_id", "row_idx", F.size("cells").alias("n"), F.array_join("cells", "|").alias("cells"))


@query(
    "t07_numbered_topics",
    r"""SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS place, CAST(turn + 1 AS VARCHAR) AS number, trim(regexp_extract(text, '[A-Za-z]+')) AS topic FROM conversations WHERE regexp_extract(text, '[A-Za-z]+') <> ''""",
)
def t07(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a text whose lines are its turns' first words, numbered in one of three ways."""
    word, n = F.regexp_extract("text", "[A-Za-z]+", 0), (F.col("turn") + 1).cast("string")
    line = F.when(F.col("turn") % 3 == 0, F.concat(n, F.lit(". "), word)).when(F.col("turn") % 3 == 1, F.concat(n, F.lit(") "), word)).otherwise(F.concat(F.lit("## Пункт "), n, F.lit(": "), word))
    turns = table(spark, d, "conversations").filter(word != "").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))["line"].alias("lines"))
    return evaluation.numbered_topics(turns.select("doc_id", F.array_join("lines", "\n").alias("text"))).select("doc_id", F.col("at").alias("place"), "number", "topic")


@query("s07_catalog", "SELECT doc_id, coalesce(nullif(lang, ''), CAST(doc_id AS VARCHAR)) AS title, source FROM documents")
def s07(spark: SparkSession, d: str) -> DataFrame:
    return files.catalog(documents(spark, d).withColumn("title", F.col("lang")))


@query(
    "s08_source_index",
    "WITH o AS (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '#' || lang ELSE source END AS source, doc_id FROM documents), u AS (SELECT * FROM o UNION ALL SELECT split_part(source, '#', 1), doc_id FROM o WHERE contains(source, '#')) SELECT source, count(*) AS documents, min(doc_id) AS first_doc FROM u GROUP BY source",
)
def s08(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return files.source_index(docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.concat_ws("#", "source", "lang")).otherwise(F.col("source"))))


@query(
    "s09_index_status",
    "WITH f AS (SELECT DISTINCT 'src' || CAST(page_id AS VARCHAR) AS source FROM pages), i AS (SELECT source, count(*) AS documents FROM documents GROUP BY source) SELECT f.source, i.documents IS NOT NULL AS indexed, coalesce(i.documents, 0) AS documents FROM f LEFT JOIN i USING (source)",
)
def s09(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "pages").select(F.concat(F.lit("src"), F.col("page_id").cast("string")).alias("source")).distinct()
    return files.index_status(listed, files.source_index(documents(spark, d)))


@query(
    "s10_missing_files",
    "SELECT DISTINCT 'src' || CAST(page_id AS VARCHAR) AS source FROM pages WHERE 'src' || CAST(page_id AS VARCHAR) LIKE 'src2%' AND 'src' || CAST(page_id AS VARCHAR) NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)",
)
def s10(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "pages").select(F.concat(F.lit("src"), F.col("page_id").cast("string")).alias("source")).distinct()
    return files.missing(listed, files.source_index(documents(spark, d)), ["src2"])


@query("s12_ingest_summary", "SELECT count(*) AS processed, count(*) FILTER (n_chars > 500) AS ingested, count(*) FILTER (doc_id % 11 = 0) AS skipped, count(*) FILTER (doc_id % 17 = 0) AS errors FROM documents")
def s12(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return files.ingest_summary(docs.select(F.floor(F.col("n_chars") / 501).alias("chunks_indexed"), (F.col("doc_id") % 11 == 0).alias("skipped"), F.when(F.col("doc_id") % 17 == 0, F.lit("bad")).alias("error")))


@query(
    "s17_upsert_keys",
    "WITH r AS (SELECT doc_id % 100 AS doc_id, doc_id // 500 AS chunk_index, doc_id AS version FROM documents) SELECT doc_id, chunk_index, max(version) AS version FROM r GROUP BY ALL",
)
def s17(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select((F.col("doc_id") % 100).alias("doc_id"), F.floor(F.col("doc_id") / 500).alias("chunk_index"), F.col("doc_id").alias("version"))
    return stores.upsert(docs, ["doc_id", "chunk_index"], "version")


@query(
    "s17_point_keys",
    "WITH h AS (SELECT doc_id, substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR) || ':0')), 1, 32) AS h FROM documents) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS key FROM h",
)
def s17k(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", stores.point_key(F.col("doc_id"), F.lit(0)).alias("key"))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 50 <> 0"), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")


TOP = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS ql, c.vec_id, c.label AS label, list_dot_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id % 50 <> 0)"""


@query("r01_vector_topk", "WITH " + TOP + ", r AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, round(score, 6) AS score FROM s) SELECT * FROM r WHERE rank <= 24")
def r01(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = vectors(spark, d)
    return retrieval.vector_top_k(rows, asked.drop("label"), 24).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("r02_vector_topk_within", "WITH " + TOP + ", r AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s WHERE ql = label) SELECT * FROM r WHERE rank <= 5")
def r02(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = vectors(spark, d)
    return retrieval.vector_top_k_in(rows, asked, 5, "label").select("query_id", "vec_id", "rank")


@query("r03_novelty", "WITH " + TOP + " SELECT query_id, round(least(1 - max(score), 1.0), 6) AS novelty FROM s GROUP BY query_id")
def r03(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = vectors(spark, d)
    near = retrieval.vector_top_k(rows, asked.drop("label"), 1)
    return retrieval.novelty(asked.select("query_id"), near).select("query_id", F.round("novelty", 6).alias("novelty"))


@query("r04_source_scan", "SELECT doc_id, source, CAST(0.55 AS DOUBLE) AS score FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(source), 'src3') ORDER BY doc_id LIMIT 50")
def r04(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.source_scan(heads(spark, d).drop("score"), ["src1", "SRC3"], 50).select("doc_id", "source", "score")


RERANK = "rr AS (SELECT query_id, doc_id, text, score, rank AS was, score + 0.15 * least((CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'tionen') AS INT) + CAST(contains(lower(text), 'ment') AS INT)) / 3, 1.0) + 0.1 * (" + QUALITY.format("text") + ") AS rerank_score FROM hd)"


def reranked(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(heads(spark, d).withColumn("keywords", F.array(*[F.lit(w) for w in ("license", "Tionen", "ment")])))


@query("r06_rerank", "WITH " + HEADS + ", " + RERANK + " SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, was) AS INT) AS rank FROM rr")
def r06(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d).select("query_id", "doc_id", "rank")


@query("r07_quality_filter", "WITH " + HEADS + ", q AS (SELECT *, (" + QUALITY.format("text") + ") >= 0.9 AS good FROM hd), m AS (SELECT *, max(good) OVER (PARTITION BY query_id) AS anyq FROM q) SELECT query_id, doc_id FROM m WHERE CASE WHEN anyq THEN good ELSE rank <= 5 END")
def r07(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.drop_low_quality(heads(spark, d), 0.9).select("query_id", "doc_id")


@query("r08_prefix_dedupe", "WITH " + HEADS + " SELECT query_id, min(doc_id) AS doc_id FROM hd GROUP BY query_id, substr(text, 1, 200)")
def r08(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dedupe_prefix(heads(spark, d)).select("query_id", "doc_id")


@query(
    "r09_neighbours",
    "WITH h AS (SELECT vec_id % 50 // 10 AS query_id, label AS doc_id, CAST(vec_id AS INT) AS chunk_index, vec_id AS rank FROM embeddings WHERE vec_id % 10 = 0), a AS (SELECT query_id, doc_id, rank, unnest([0, 1, 2]) AS place, unnest([chunk_index, chunk_index - 1, chunk_index + 1]) AS chunk_index FROM h), f AS (SELECT a.* FROM a JOIN embeddings e ON e.vec_id = a.chunk_index AND e.label = a.doc_id), o AS (SELECT query_id, doc_id, chunk_index, min(rank * 3 + place) AS k FROM f GROUP BY ALL), r AS (SELECT query_id, doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INT) AS rank FROM o) SELECT * FROM r WHERE rank <= 16",
)
def r09(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").cast("int").alias("chunk_index"), F.lit("a text of some words that is long enough").alias("text"))
    hits = e.filter("chunk_index % 10 = 0").select(F.floor(F.col("chunk_index") % 50 / 10).alias("query_id"), "doc_id", "chunk_index", F.col("chunk_index").alias("rank"))
    return retrieval.expand_neighbours(hits, e, 12).select("query_id", "doc_id", "chunk_index", "rank")


def problems(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's first turn is a query."""
    return table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("problem"), F.lit("").alias("constraints"))


CASES = "ca AS (SELECT * FROM (VALUES (0, 'dir0', 'tion'), (1, 'dir1', 'ß'), (2, 'dir2', 'ement')) t(case_no, dir, kw))"


@query(
    "r10_case_routing",
    "WITH " + CASES + ", q AS (SELECT conv_id AS query_id, lower(text) AS t FROM conversations WHERE turn = 0), m AS (SELECT query_id, case_no, dir FROM q JOIN ca ON contains(t, kw)), b AS (SELECT query_id, case_no, dir FROM q, ca WHERE contains(t, 'os ') AND query_id NOT IN (SELECT query_id FROM m)) SELECT * FROM m UNION ALL SELECT * FROM b",
)
def r10(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.route_cases(problems(spark, d), cases(spark), ["os "])


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "dir0", "one", ["tion"], ["a", "b"]), (1, "dir1", "two", ["ß"], ["c"]), (2, "dir2", "three", ["ement"], ["a"])], "case_no int, dir string, label string, keywords array<string>, hints array<string>")


@query(
    "r11_case_hints",
    "WITH " + CASES + ", hi AS (SELECT * FROM (VALUES (0, 'one: a'), (0, 'one: b'), (1, 'two: c'), (2, 'three: a')) t(case_no, hint)), m AS (SELECT conv_id AS query_id, case_no FROM conversations JOIN ca ON contains(lower(text), kw) WHERE turn = 0) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY case_no, hint) AS INT) AS rank, hint FROM m JOIN hi USING (case_no)",
)
def r11(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.case_hints(retrieval.route_cases(problems(spark, d), cases(spark), []), cases(spark))


@query("r12_source_boost", "SELECT doc_id, CAST(CASE WHEN contains(lower(source), 'src1') THEN 0.35 ELSE 0.0 END AS DOUBLE) AS boost FROM documents")
def r12(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", retrieval.source_boost(F.col("source"), F.array(F.lit("SRC1"))).alias("boost"))


@query("r13_case_score", "SELECT doc_id, least(1.0, 0.7 * ((CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'ment') AS INT)) / 2) + CASE WHEN contains(lower(text), 'license') THEN 0.08 ELSE 0.0 END) AS score FROM documents WHERE text <> ''")
def r13(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter("text <> ''").select("doc_id", retrieval.case_score(F.col("text"), F.array(F.lit("tion"), F.lit("Ment"), F.lit("abc")), ("license",)).alias("score"))


@query(
    "r16_injection",
    "WITH " + HEADS + ", h AS (SELECT * FROM hd WHERE doc_id % 3 <> 0), x AS (SELECT query_id, doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS stage, CASE WHEN doc_id % 4 = 3 THEN score ELSE 0 END AS opt FROM hd WHERE doc_id % 3 = 0 AND doc_id % 7 < 4), e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, opt DESC, doc_id) AS place FROM x), u AS (SELECT query_id, doc_id, 0 AS part, place FROM e WHERE place <= 6 UNION ALL SELECT query_id, doc_id, 1, rank FROM h), r AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS INT) AS rank FROM u) SELECT * FROM r WHERE rank <= 40",
)
def r16(spark: SparkSession, d: str) -> DataFrame:
    h = heads(spark, d)
    kind = F.when(F.col("doc_id") % 4 == 0, "kpi").when(F.col("doc_id") % 4 == 1, "brainstorm").when(F.col("doc_id") % 4 == 2, "other")
    extra = h.filter("doc_id % 3 = 0 AND doc_id % 7 < 4").withColumns({"kind": kind, "example_score": F.col("score")})
    return retrieval.inject(h.filter("doc_id % 3 <> 0"), extra, 6, 40).select("query_id", "doc_id", "rank")


@query(
    "r22_conflicts",
    "WITH " + HEADS + ", d AS (SELECT *, contains(lower(text), 'ing ') OR contains(lower(text), 'en der') AS u, contains(lower(text), 'eux ') OR contains(lower(text), 'tion,') AS w FROM hd), x AS (SELECT query_id, rank, doc_id, u, unnest(regexp_extract_all(lower(text), '[а-яa-z]{7,}')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[а-яa-z]{7,}'), 1) AS pos FROM d WHERE u <> w), g AS (SELECT query_id, term, min(rank * 1000000 + pos) AS first, CAST(count(DISTINCT doc_id) AS INT) AS n_docs FROM x GROUP BY ALL HAVING count(DISTINCT u) = 2), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INT) AS rank, term, n_docs FROM g) SELECT * FROM r WHERE rank <= 5",
)
def r22(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.conflicts(heads(spark, d), UP, DOWN, ()).select("query_id", "rank", "term", F.size("docs").alias("n_docs"))


@query(
    "r23_gaps",
    r"""WITH q AS (SELECT conv_id AS query_id, lower(text) AS t FROM conversations WHERE turn = 0), h AS (SELECT conv_id AS query_id, lower(text) AS t FROM conversations WHERE turn > 0), tp AS (SELECT * FROM (VALUES (0, 'endings', 'tion|ment'), (1, 'sharp', 'ß'), (2, 'numbers', '[0-9]{3}'), (3, 'accent', 'é|è'), (4, 'plural', 'os |as ')) v(pos, topic, pat)),
a AS (SELECT query_id, pos, topic, 'high' AS severity FROM q, tp WHERE regexp_matches(t, pat) AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = q.query_id AND regexp_matches(h.t, pat))),
w AS (SELECT query_id, unnest(k) AS topic, generate_subscripts(k, 1) + 999 AS pos FROM (SELECT query_id, list_distinct(regexp_extract_all(t, '[а-яёa-z]{5,}')) AS x, list_filter(regexp_extract_all(t, '[а-яёa-z]{5,}'), lambda w, i: list_position(regexp_extract_all(t, '[а-яёa-z]{5,}'), w) = i)[1:12] AS k FROM q)),
m AS (SELECT query_id, pos, topic, 'medium' AS severity FROM w WHERE length(topic) >= 6 AND topic NOT IN ('thation', 'ouement') AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = w.query_id AND contains(h.t, topic))),
f AS (SELECT query_id, 1000000 AS pos, 'объём контекста' AS topic, 'high' AS severity FROM q WHERE (SELECT count(*) FROM h WHERE h.query_id = q.query_id) < 5),
u AS (SELECT query_id, topic, arg_min(severity, pos) AS severity, min(pos) AS pos FROM (SELECT * FROM a UNION ALL SELECT query_id, pos, topic, severity FROM m UNION ALL SELECT * FROM f) GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INT) AS rank, topic, severity FROM u) SELECT * FROM r WHERE rank <= 8""",
)
def r23(spark: SparkSession, d: str) -> DataFrame:
    asked = problems(spark, d).withColumn("keywords", tx.problem_keywords(F.col("problem"), F.col("constraints")))
    turns = table(spark, d, "conversations").filter("turn > 0").select(F.col("conv_id").alias("query_id"), "text")
    return retrieval.knowledge_gaps(asked, turns, TOPICS, STOP)


@query("r24_source_rollup", "WITH g AS (SELECT lang AS query_id, source AS doc_id, count(*) AS chunks, max(doc_id * 7919 % 1000 / 1000.0) AS max_score FROM documents GROUP BY ALL) SELECT query_id, doc_id, chunks, max_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY max_score DESC, doc_id) AS INT) AS rank FROM g")
def r24(spark: SparkSession, d: str) -> DataFrame:
    hits = heads(spark, d).withColumn("doc_id", F.col("source"))
    titles = hits.select("doc_id", F.lit("").alias("title")).distinct()
    return retrieval.source_rollup(hits, titles).select("query_id", "doc_id", "chunks", "max_score", "rank")


@query("r25_doc_corpus", "SELECT conv_id AS query_id, role AS doc_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text <> '' GROUP BY ALL")
def r25(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("doc_id"), "text", F.col("turn").alias("rank"))
    return retrieval.doc_corpus(turns).select("query_id", "doc_id", F.md5("corpus").alias("digest"))


def planted(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, doc_id, snippet, corpus): benchmark passages and the documents that hold their first long word."""
    word = F.regexp_extract(F.lower("text"), "[a-z]{9,}", 0)
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("snippet"), word.alias("w")).filter("w <> ''")
    words = documents(spark, d).select("doc_id", F.col("text").alias("corpus"), F.explode(F.array_distinct(tx.all_of(F.lower("text"), "[a-z]{9,}"))).alias("w"))
    return items.join(words, "w").drop("w")


PLANTED = """it AS (SELECT item_id, text AS snippet, regexp_extract(lower(text), '[a-z]{9,}') AS w FROM benchmark), dw AS (SELECT doc_id, text AS corpus, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS w FROM documents), pl AS (SELECT item_id, doc_id, snippet, corpus FROM it JOIN dw USING (w) WHERE it.w <> '')"""
TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]{{3,}}'))"
FORM = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({}), 'ё', 'е'), '[\s\-—–]+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("c01_token_overlap", "WITH " + PLANTED + " SELECT item_id, doc_id, len(list_intersect(" + TOKENS.format("snippet") + ", " + TOKENS.format("corpus") + ")) / len(" + TOKENS.format("snippet") + ") AS overlap FROM pl")
def c01(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("item_id", "doc_id", citations.token_overlap(F.col("snippet"), F.col("corpus")).alias("overlap"))


@query(
    "c02_substring_overlap",
    "WITH " + PLANTED + ", f AS (SELECT item_id, doc_id, " + FORM.format("snippet") + " AS s, " + FORM.format("corpus") + " AS c, " + TOKENS.format("corpus") + " AS ct FROM pl), w AS (SELECT *, string_split(s, ' ') AS words FROM f), g AS (SELECT *, least(len(words), 24) AS n FROM w), r AS (SELECT *, list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' ')) AS runs FROM g) SELECT item_id, doc_id, CASE WHEN contains(c, s) THEN 1.0 ELSE list_max(list_transform(runs, lambda x: CASE WHEN contains(c, x) THEN 1.0 ELSE len(list_intersect(" + TOKENS.format("x") + ", ct)) / greatest(len(" + TOKENS.format("x") + "), 1) END)) END AS overlap FROM r",
)
def c02(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("item_id", "doc_id", citations.substring_overlap(F.col("snippet"), F.col("corpus")).alias("overlap"))


@query("c08_align")
def c08(spark: SparkSession, d: str) -> DataFrame:
    """Alignment of passages with the documents that hold three words in a row of theirs."""
    found = citations.candidates(table(spark, d, "benchmark").select("item_id", F.col("text").alias("snippet")), documents(spark, d).select("doc_id", F.col("text").alias("corpus")))
    pairs = found.withColumn("pair_id", F.concat_ws("-", "item_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("copy") > 1, F.col("copy"))))
    return citations.align(pairs.select("pair_id", "snippet", "corpus"))


@query(
    "v03_topic_recall",
    """WITH o AS (SELECT lang AS case_id, lower(string_agg(text, ' ')) AS low FROM documents GROUP BY lang), l AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS case_id), t AS (SELECT case_id, list_distinct(regexp_extract_all(lower(text), '[а-яёa-z]{4,}')) AS w FROM benchmark, l), j AS (SELECT t.case_id, w, len(list_filter(w, lambda x: contains(low, x))) AS hits FROM t LEFT JOIN o USING (case_id)) SELECT case_id, count(*) AS topics, count(*) FILTER (len(w) > 0 AND hits >= greatest(1, len(w) // 3)) AS found, round(count(*) FILTER (len(w) > 0 AND hits >= greatest(1, len(w) // 3)) / count(*), 3) AS recall FROM j GROUP BY case_id""",
)
def v03(spark: SparkSession, d: str) -> DataFrame:
    """A language's documents are a case, and all benchmark passages are each case's topics."""
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])).alias("case_id")
    topics = table(spark, d, "benchmark").select(langs, F.col("text").alias("topic"))
    return evaluation.topic_recall(topics, documents(spark, d).select(F.col("lang").alias("case_id"), "text"), stop=())
