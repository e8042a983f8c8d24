"""Hybrid retrieval for many queries at once.

Tables: chunks(doc_id, chunk_index, text, source, title), hits(query_id, doc_id, chunk_index, score, rank, ...),
queries(query_id, problem, constraints). Ties go by an explicit rank or id, never by chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from .containment import containing
from .lineage import settled
from .ranks import ranked_wide
from .vectors import blocked_top_k

FIRST_STAGE = 3
LEAST_FIRST_STAGE = 24


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], most: int | None = None, name: str = "rank") -> DataFrame:
    """A row's place (from 1) among those that share `by`; the first `most`. Spark limits groups before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.filter(F.col(name) <= most)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) nearest by cosine to each query (query_id, query_vector).

    Unit vectors are expected. Blocks of rows meet blocks of queries as matrix products (vectors.py); of a block k rows a query are
    shuffled. Ties go to the smaller vec_id.
    """
    return ranked(blocked_top_k(vectors, queries, k, exclude_self=exclude_self), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def vector_top_k_in(vectors: DataFrame, queries: DataFrame, k: int, within: str) -> DataFrame:
    """The same among the rows that share column `within` with the query; a large group is dealt into blocks."""
    return ranked(blocked_top_k(vectors, queries, k, [within]), ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "vec_id", within, "score", "rank")


def novelty(queries: DataFrame, nearest: DataFrame) -> DataFrame:
    """1 - best cosine, at most 1; 1 where nothing is near."""
    best = nearest.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.join(best, "query_id", "left").withColumn("novelty", F.coalesce(F.least(1 - F.col("best"), F.lit(1.0)), F.lit(1.0)))


def source_scan(chunks: DataFrame, patterns: Sequence[str], most: int, score: float = 0.55) -> DataFrame:
    """Chunks whose source contains any pattern, the first `most` by (doc_id, chunk_index). Each distinct source is looked at
    once, for all patterns together."""
    wanted = chunks.sparkSession.createDataFrame([(p.lower(),) for p in patterns], "pattern string")
    low = chunks.withColumn("__low", F.lower("source"))
    hit = containing(low, "__low", wanted, "pattern").select("__low").distinct()
    return low.join(hit, "__low", "left_semi").drop("__low").withColumn("score", F.lit(score)).orderBy("doc_id", "chunk_index").limit(most)


def lookup(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks by (doc_id, chunk_index); score 0."""
    return wanted.join(chunks, ["doc_id", "chunk_index"]).withColumn("score", F.lit(0.0))


def source_boost(source: Column, dirs: Column, base: float = 0.35) -> Column:
    """For a source in one of the dirs; more for brainstorm and table sources."""
    low = F.lower(F.coalesce(source, F.lit("")))
    more = F.when(low.contains("гипотез"), 0.12).otherwise(0.0) + F.when(low.endswith(".xlsx") | low.contains("хвост"), 0.18).otherwise(0.0)
    return F.when(F.exists(dirs, lambda d: low.contains(F.lower(d))), base + more).otherwise(F.lit(0.0))


def keyword_share(text: Column, keywords: Column) -> Column:
    low = F.lower(text)
    return F.least(F.size(F.filter(keywords, lambda k: low.contains(F.lower(k)))) / F.greatest(F.size(keywords), F.lit(1)), F.lit(1.0))


def rerank_score(boost: Column | None = None) -> Column:
    """The score of a hit (score, text, keywords) by its wording."""
    final = F.col("score") + 0.15 * keyword_share(F.col("text"), F.col("keywords")) + 0.1 * tx.quality(F.col("text")) + tx.kpi_boost(F.col("text"))
    return F.when(F.size("keywords") == 0, F.col("score")).otherwise(final if boost is None else final + boost)


def rerank(hits: DataFrame, boost: Column | None = None) -> DataFrame:
    """rerank_score and rank of hits (query_id, rank, score, text, keywords); score stays as it is."""
    hits = hits.withColumn("rerank_score", rerank_score(boost)).withColumnRenamed("rank", "was")
    return ranked_wide(hits, ["query_id"], [F.desc("rerank_score"), F.asc("was")]).drop("was")


def drop_low_quality(hits: DataFrame, least: float = 0.15, keep: int = 5) -> DataFrame:
    """Hits of some quality; the first `keep` of a query where none has it."""
    marked = settled(hits.withColumn("__good", tx.quality(F.col("text")) >= least))
    some = marked.groupBy("query_id").agg(F.max("__good").alias("__any"))  # a query's hits are gathered nowhere
    return marked.join(some, "query_id").filter(F.when(F.col("__any"), F.col("__good")).otherwise(F.col("rank") <= keep)).select(*hits.columns)


def dedupe_prefix(hits: DataFrame, head: int = 200) -> DataFrame:
    """Of hits of a query that begin alike, the best ranked."""
    hits = hits.withColumn("__head", F.substring("text", 1, head))
    return ranked(hits, ["query_id", "__head"], [F.asc("rank")], 1, "__n").drop("__n", "__head")


def best_of_few(hits: DataFrame, least: float = 0.15, keep: int = 5, head: int = 200, boost: Column | None = None) -> DataFrame:
    """R06, R07 and R08 in one for hits of which a query has some tens (query_id, rank, score, text, keywords): rerank_score and rank, without
    their texts. What counts of a text is worked out before hits are dealt by query, once."""
    scored = hits.withColumns({"rerank_score": rerank_score(boost), "__good": tx.quality(F.col("text")) >= least, "__head": F.sha2(F.substring("text", 1, head), 256)}).drop("text", "keywords")
    own = Window.partitionBy("query_id")
    placed = ranked(scored.withColumnRenamed("rank", "__was"), ["query_id"], [F.desc("rerank_score"), F.asc("__was")]).withColumn("__any", F.max("__good").over(own))
    kept = placed.filter(F.when(F.col("__any"), F.col("__good")).otherwise(F.col("rank") <= keep))
    return ranked(kept, ["query_id", "__head"], [F.asc("rank")], 1, "__n").drop("__n", "__head", "__good", "__any", "__was")


def expand_neighbours(hits: DataFrame, chunks: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """Each hit and then its neighbours of some quality, each chunk once, k + 4 at most; rank is new. A hit keeps its score,
    where hits have one; a neighbour's is 0."""
    scored = "score" in hits.columns
    score = [F.col("score").alias("__score")] if scored else []
    around = hits.select("query_id", "doc_id", *score, F.col("rank").alias("hit"), F.posexplode(F.array(F.col("chunk_index"), F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("place", "chunk_index")).filter("chunk_index >= 0")
    own = chunks.select("doc_id", "chunk_index", "text")
    found = around.join(own, ["doc_id", "chunk_index"]).filter((F.col("place") == 0) | (tx.quality(F.col("text")) >= least))
    once = ranked(found, ["query_id", "doc_id", "chunk_index"], [F.asc("hit"), F.asc("place")], 1, "__n").drop("__n")
    out = ranked(once, ["query_id"], [F.asc("hit"), F.asc("place")], k + 4).withColumn("expanded", F.col("place") > 0).drop("hit", "place")
    return out.withColumn("score", F.when(F.col("expanded"), F.lit(0.0)).otherwise(F.col("__score"))).drop("__score") if scored else out


#: A registry of cases has no more rows.
CASES = 10_000


def route_cases(queries: DataFrame, cases: DataFrame, broad: Sequence[str]) -> DataFrame:
    """(query_id, case_no, dir) of the cases (case_no, dir, keywords) that a query names; all, if it names none but a broad keyword."""
    text = F.lower(F.concat_ws(" ", "problem", "constraints"))
    q = queries.select("query_id", text.alias("__text"))
    words = cases.select("case_no", "dir", F.explode("keywords").alias("w")).select("case_no", "dir", F.lower("w").alias("__word"))
    met = containing(q, "__text", words, "__word").join(words, "__word")
    named = q.join(met, "__text").select("query_id", "case_no", "dir").distinct()
    rest = q.join(named.select("query_id").distinct(), "query_id", "left_anti").filter(tx.contains_any(F.col("__text"), list(broad))).select("query_id")
    numbers = sorted(r[0] for r in cases.select("case_no").limit(CASES + 1).collect())
    if len(numbers) > CASES:
        raise ValueError(f"a registry has {CASES} cases at most")
    every = rest.withColumn("case_no", F.explode(F.array(*[F.lit(n) for n in numbers]).cast(f"array<{cases.schema['case_no'].dataType.simpleString()}>")))
    return named.unionByName(every.join(cases.select("case_no", "dir"), "case_no").select("query_id", "case_no", "dir"))


def case_registry(items: DataFrame) -> DataFrame:
    """The example cases (at, id, dir, label, keywords, hints) as a table: numbered in order, keywords in lower case, the id
    where there is no label, no nulls. A registry has some tens of rows."""
    none = F.array().cast("array<string>")
    c = items.withColumns({"label": F.coalesce("label", F.col("id").cast("string")), "dir": F.coalesce("dir", F.lit("")), "keywords": F.transform(F.coalesce("keywords", none), F.lower), "hints": F.coalesce("hints", none)})
    return ranked(c, [], [F.asc("at")], None, "case_no").select("case_no", "id", "dir", "label", "keywords", "hints")


def rule_hints(queries: DataFrame, rules: Sequence[tuple[Sequence[str], str]] = lx.RULE_HINTS) -> DataFrame:
    """(query_id, rank, hint): what a query's wording calls for, whatever its cases, in the order of the rules."""
    low = F.lower(F.concat_ws(" ", "problem", "constraints"))
    found = F.filter(F.array(*[F.when(tx.contains_any(low, words), F.lit(hint)) for words, hint in rules]), lambda x: x.isNotNull())
    return queries.select("query_id", F.posexplode(found).alias("rank", "hint")).withColumn("rank", F.col("rank") + 1)


def all_hints(queries: DataFrame, routes: DataFrame, cases: DataFrame) -> DataFrame:
    """The hints of a query's cases, then those of the rules."""
    own = case_hints(routes, cases).withColumn("__part", F.lit(0))
    both = own.unionByName(rule_hints(queries).withColumn("__part", F.lit(1)))
    return ranked(both.withColumnRenamed("rank", "__was"), ["query_id"], [F.asc("__part"), F.asc("__was")]).select("query_id", "rank", "hint")


def case_candidates(chunks: DataFrame, routes: DataFrame, queries: DataFrame, mandatory: DataFrame, inject: int = 4, few: int = 2) -> DataFrame:
    """For queries with under `few` mandatory chunks (query_id, ...) the first chunks (R04) of the cases' folders, boosted
    (R12) and scored (R13): hits with kind null. routes: query_id, dir; queries: query_id, keywords. A folder's chunks are
    taken once, however many queries it serves."""
    most = max(3 * inject, 8)
    dirs = routes.select("dir").distinct()
    low, folders = chunks.withColumn("__low", F.lower("source")), dirs.withColumn("__dir", F.lower("dir"))
    inside = low.join(containing(low, "__low", folders, "__dir"), "__low").join(folders, "__dir").drop("__low", "__dir")
    first = ranked(inside, ["dir"], [F.asc("doc_id"), F.asc("chunk_index")], most, "__n").drop("__n")
    served = mandatory.groupBy("query_id").count().filter(F.col("count") >= few).select("query_id")
    open_ = routes.select("query_id", "dir").join(served, "query_id", "left_anti")
    found = ranked(open_.join(first, "dir"), ["query_id"], [F.asc("doc_id"), F.asc("chunk_index"), F.asc("dir")], most, "__n").drop("__n")
    boosted = found.join(queries.select("query_id", "keywords"), "query_id").withColumns(
        {"example_score": case_score(F.col("text"), F.col("keywords")), "score": 0.55 + source_boost(F.col("source"), F.array("dir")), "kind": F.lit(None).cast("string")}
    )
    return boosted.select("query_id", "doc_id", "chunk_index", "text", "score", "kind", "example_score")


def case_hints(routes: DataFrame, cases: DataFrame) -> DataFrame:
    """The hints of a query's cases in order, each once."""
    hints = cases.select("case_no", "label", F.posexplode("hints").alias("hint_no", "hint"))
    found = routes.join(hints, "case_no").withColumn("hint", F.concat_ws(": ", "label", "hint"))
    once = ranked(found, ["query_id", "hint"], [F.asc("case_no"), F.asc("hint_no")], 1, "__n")
    return ranked(once, ["query_id"], [F.asc("case_no"), F.asc("hint_no")], None, "rank").select("query_id", "rank", "hint")


def case_score(text: Column, keywords: Column, marks: Sequence[str] = ("извлекаемый металл", "гипотеза", "мозгового штурма", "хвост")) -> Column:
    """Relevance of a case's chunk to the keywords, 0 to 1."""
    low = F.lower(text)
    long = F.filter(keywords, lambda k: F.length(k) >= 4)
    base = F.when(F.size(long) == 0, F.lit(0.5)).otherwise(0.7 * F.size(F.filter(long, lambda k: low.contains(F.lower(k)))) / F.size(long))
    bonus = sum((F.when(low.contains(m), 0.08).otherwise(0.0) for m in marks), tx.kpi_boost(text))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), base + bonus))


def injection_order(boost: Column | None = None) -> list[Column]:
    """boost: the text's KPI mark where it is worked out already."""
    stage = F.when(F.col("kind") == "kpi", 0).when(F.col("kind") == "brainstorm", 1).when(F.col("kind").isNotNull(), 2).otherwise(3)
    optional = F.when(F.col("kind").isNull(), F.col("example_score")).otherwise(F.lit(0.0))
    return [F.asc(stage), F.desc(tx.kpi_boost(F.col("text")) if boost is None else boost), F.desc(optional), F.asc("doc_id"), F.asc("chunk_index")]


def inject(hits: DataFrame, extra: DataFrame, most: int, k: int) -> DataFrame:
    """Extra hits (kind, example_score) before the others: mandatory ones (kpi, brainstorm, other), then optional
    ones by KPI mark (boost, where it is worked out already) and score; those already there are skipped, `most` go in, and k
    stay. Hits may come without their texts."""
    if "boost" not in extra.columns:
        extra = extra.withColumn("boost", tx.kpi_boost(F.col("text")))  # before rows are dealt out, so that their order needs no text
    new = extra.join(hits.select("query_id", "doc_id", "chunk_index"), ["query_id", "doc_id", "chunk_index"], "left_anti")
    order = injection_order(F.col("boost"))
    once = ranked(new, ["query_id", "doc_id", "chunk_index"], order, 1, "__n")
    first = ranked(once, ["query_id"], order, most, "__place")
    text = ["text"] if "text" in hits.columns else []
    both = first.select("query_id", "doc_id", "chunk_index", *text, "score", F.lit(0).alias("__part"), "__place").unionByName(
        hits.select("query_id", "doc_id", "chunk_index", *text, "score", F.lit(1).alias("__part"), F.col("rank").alias("__place"))
    )
    return ranked(both, ["query_id"], [F.asc("__part"), F.asc("__place")], k).drop("__part", "__place")


def chunk_direction(text: Column, up: Sequence[str], down: Sequence[str]) -> Column:
    low = F.lower(text)
    a, b = tx.contains_any(low, up), tx.contains_any(low, down)
    return F.when(a & ~b, F.lit("increase")).when(b & ~a, F.lit("decrease"))


def conflicts(hits: DataFrame, up: Sequence[str] = lx.INCREASE, down: Sequence[str] = lx.DECREASE, stop: Sequence[str] = lx.CONFLICT_STOP, least: int = 7, most: int = 5) -> DataFrame:
    """(query_id, rank, term, docs, message) of terms that chunks of both directions use, in order of first use."""
    directed = hits.withColumn("direction", chunk_direction(F.col("text"), up, down)).filter("direction IS NOT NULL")
    words = directed.select("query_id", "rank", "doc_id", "direction", F.posexplode(tx.all_of(F.lower("text"), f"[а-яa-z]{{{least},}}")).alias("at", "term"))
    words = words.filter(~F.col("term").isin(list(stop)))
    terms = words.groupBy("query_id", "term").agg(F.min("direction").alias("low"), F.max("direction").alias("high"), F.min(F.struct("rank", "at")).alias("first")).filter("low <> high")
    best = ranked(terms, ["query_id"], [F.asc("first.rank"), F.asc("first.at")], most).select("query_id", "term", "rank")
    docs = words.select("query_id", "term", "doc_id").join(best, ["query_id", "term"]).groupBy("query_id", "term").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    found = best.join(docs, ["query_id", "term"])
    # fixed values: the two messages
    names = F.array_join(F.transform("docs", lambda d: d.cast("string")), ", ")
    one = F.concat(F.lit("Противоречие по «"), "term", F.lit("» в документе "), names, F.lit(": в разных фрагментах указаны противоположные эффекты"))
    many = F.concat(F.lit("Противоречие по «"), "term", F.lit("»: разные источники ("), names, F.lit(") указывают на противоположные эффекты"))
    return found.select("query_id", "rank", "term", "docs", F.when(F.size("docs") == 1, one).otherwise(many).alias("message"))


def knowledge_gaps(queries: DataFrame, hits: DataFrame, topics: Sequence[tuple[str, str]] = lx.GAP_TOPICS, stop: Sequence[str] = lx.GAP_STOP, enough: int = 5, most: int = 8) -> DataFrame:
    """(query_id, rank, topic, severity): topics a query asks for that no hit covers, keywords that no hit
    holds, and too few hits. queries: query_id, problem, constraints, keywords (lower-cased)."""
    asked = F.concat_ws(" ", "problem", "constraints")
    flags = hits.groupBy("query_id").agg(F.count("*").alias("hits"), *[F.max(tx.matches(F.col("text"), p)).alias(f"__t{i}") for i, (_, p) in enumerate(topics)])
    q = queries.join(flags, "query_id", "left")
    by_topic = F.filter(
        F.array(*[F.when(tx.matches(asked, p) & ~F.coalesce(F.col(f"__t{i}"), F.lit(False)), F.struct(F.lit(i).alias("at"), F.lit(t).alias("topic"), F.lit("high").alias("severity"))) for i, (t, p) in enumerate(topics)]),
        lambda x: x.isNotNull(),
    ) if topics else F.array()
    gaps = q.select("query_id", F.explode(by_topic).alias("g")).select("query_id", F.col("g.at").alias("at"), F.col("g.topic").alias("topic"), F.col("g.severity").alias("severity"))
    words = queries.select("query_id", F.posexplode("keywords").alias("at", "topic")).filter((F.length("topic") >= 6) & ~F.col("topic").isin(list(stop)))
    held = hits.join(words, "query_id").filter(F.lower("text").contains(F.col("topic"))).select("query_id", "topic").distinct()
    missing = words.join(held, ["query_id", "topic"], "left_anti").select("query_id", (F.col("at") + 1000).alias("at"), "topic", F.lit("medium").alias("severity"))
    few = q.filter(F.coalesce("hits", F.lit(0)) < enough).select("query_id", F.lit(10**6).alias("at"), F.lit("объём контекста").alias("topic"), F.lit("high").alias("severity"))
    once = ranked(gaps.union(missing).union(few), ["query_id", "topic"], [F.asc("at")], 1, "__n").drop("__n")
    return ranked(once, ["query_id"], [F.asc("at")], most).select("query_id", "rank", "topic", "severity")


def source_rollup(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks and best score of each document of a query, best first; the title falls back to the id."""
    by_doc = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("chunks"), F.max("score").alias("max_score"))
    titled = by_doc.join(catalog.select("doc_id", "title"), "doc_id", "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id").cast("string")))
    return ranked(titled, ["query_id"], [F.desc("max_score"), F.asc("doc_id")])


def doc_corpus(hits: DataFrame) -> DataFrame:
    """The texts of a query's hits of one document, joined in rank order."""
    parts = hits.filter(F.coalesce("text", F.lit("")) != "").groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("p"))
    return parts.select("query_id", "doc_id", F.array_join("p.text", "\n").alias("corpus"))


def expand_keywords(words: DataFrame, aliases: DataFrame, most: int = 20) -> DataFrame:
    """Keywords (query_id, at, word) and the aliases (term, alias, and place where their order counts) of terms that contain them or
    that they contain. A keyword's aliases stand by place, then by themselves."""
    placed = aliases if "place" in aliases.columns else aliases.withColumn("place", F.lit(0))
    w, a = words.withColumn("__word", F.lower("word")), placed.withColumn("__term", F.lower("term"))
    pairs = containing(w, "__word", a, "__term").unionByName(containing(a, "__term", w, "__word")).distinct()
    met = w.join(pairs, "__word").join(a, "__term")
    both = words.select("query_id", "at", F.lit(0).alias("side"), F.lit(0).alias("place"), "word").union(met.select("query_id", "at", F.lit(1).alias("side"), "place", F.col("alias").alias("word")))
    order = [F.asc("at"), F.asc("side"), F.asc("place"), F.asc("word")]
    return ranked(ranked(both, ["query_id", "word"], order, 1, "__n").drop("__n"), ["query_id"], order, most).select("query_id", "rank", "word")


def subgraphs(nodes: DataFrame, edges: DataFrame, keywords: DataFrame, most: int = 30) -> DataFrame:
    """For each query the edges (query_id, id, name, other, type, rank) at nodes (id, name) whose name holds one of its keywords
    (query_id, keyword), with the node on the other side; the first `most`. All queries' keywords are looked for in one pass."""
    low, asked = nodes.select("id", "name", F.lower("name").alias("__name")), keywords.select("query_id", F.lower("keyword").alias("__keyword")).distinct()
    met = containing(low, "__name", asked, "__keyword").join(asked, "__keyword").select("query_id", "__name").distinct()
    hit = low.join(met, "__name").select("query_id", "id", "name")
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "type").union(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "type"))
    return ranked(hit.join(ends, "id", "left"), ["query_id"], [F.asc("id"), F.asc("other"), F.asc("type")], most).select("query_id", "id", "name", "other", "type", "rank")


def subgraph(nodes: DataFrame, edges: DataFrame, keywords: Sequence[str], most: int = 30) -> DataFrame:
    """The same for one list of keywords."""
    asked = nodes.sparkSession.createDataFrame([(0, k) for k in keywords], "query_id int, keyword string")
    return subgraphs(nodes, edges, asked, most).orderBy("rank").drop("query_id", "rank")


def subgraph_nodes(nodes: DataFrame, edges: DataFrame, keywords: Sequence[str], most: int = 30) -> DataFrame:
    """The nodes (id, name, label) of subgraph(): those whose name holds a keyword (hop 0) and their neighbours (hop 1)."""
    part = subgraph(nodes, edges, keywords, most)
    ends = part.select("id", F.lit(0).alias("hop")).union(part.filter("other IS NOT NULL").select(F.col("other"), F.lit(1)))
    return ends.groupBy("id").agg(F.min("hop").alias("hop")).join(nodes, "id").select("id", "name", "label", "hop")


def merge_graphs(graphs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows (graph_no, at, ...) once for each key; the first graph wins."""
    return ranked(graphs, list(key), [F.asc("graph_no"), F.asc("at")], 1, "__n").drop("__n")
