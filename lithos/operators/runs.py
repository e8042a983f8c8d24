"""Whole runs: from problems and a corpus to stored, ordered hypotheses (H19), with the whole retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions import text as tx
from lithos.sources import stores

from . import proposals, retrieval
from .lineage import settled

_EXTRA = ["query_id", "doc_id", "chunk_index", "boost", "score", "kind", "example_score"]


def whole_retrieval(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, routes: DataFrame, brought: DataFrame, k: int = 12, inject: int = 4) -> DataFrame:
    """Vectors, boosts of the cases' folders, rerank, quality, dedupe, what the cases always bring (R15), where that is little the first
    chunks of their folders (R14), injection and neighbours: (query_id, rank, doc_id, chunk_index, text, score, expanded, source, is_example).

    chunks: doc_id, chunk_index, text, source, vec_id; vectors: vec_id, embedding; queries: query_id, query_vector, problem, constraints;
    routes: query_id, case_no, dir (R10); brought: dir and mandatory()'s columns.
    """
    dirs = routes.groupBy("query_id").agg(F.sort_array(F.collect_set("dir")).alias("dirs"))  # as many as a query has cases
    asked = settled(queries.join(dirs, "query_id", "left").withColumn("dirs", F.coalesce("dirs", F.array().cast("array<string>"))))
    own = settled(proposals.case_extras(routes, brought, k, inject).select(*_EXTRA))
    words = asked.select("query_id", tx.keywords(F.concat_ws(" ", "problem", "constraints")).alias("keywords"))
    more = retrieval.case_candidates(chunks.select("doc_id", "chunk_index", "text", "source"), routes, words, own.select("query_id"), inject)
    extra = settled(own.unionByName(more.withColumn("boost", tx.kpi_boost(F.col("text"))).select(*_EXTRA)))
    hits = proposals.retrieve(chunks, vectors, asked, extra, k, inject)
    named = hits.join(chunks.select("doc_id", "chunk_index", "source").dropDuplicates(["doc_id", "chunk_index"]), ["doc_id", "chunk_index"], "left")
    example = extra.select("query_id", "doc_id", "chunk_index").distinct().withColumn("is_example", F.lit(True))
    return named.join(example, ["query_id", "doc_id", "chunk_index"], "left").withColumn("is_example", F.coalesce("is_example", F.lit(False)))


def run(
    problems: DataFrame, chunks: DataFrame, vectors: DataFrame, cases: DataFrame, brought: DataFrame, samples: DataFrame, reviews: DataFrame, folder: str | None = None,
    broad: Sequence[str] = (), k: int = 12, inject: int = 4,
) -> dict[str, DataFrame]:
    """Problems (query_id, problem, query_vector, n, and constraints where they are told apart) to ordered verdicts.

    Constraints are split off (T15), cases routed (R10), hits retrieved (whole_retrieval()), gaps (R23), conflicts (R22) and hints (R11)
    found, context and prompt written for a generator outside (T32, T33), whose answers are samples (run_id = query_id, sample_no, raw); these
    become judged and ordered hypotheses (proposals.generate()). With a folder, hypotheses are kept there by run (S22), and
    read back. Returned: hits, gaps, conflicts, prompts, sources, hypotheses, summary.
    """
    told = problems if "constraints" in problems.columns else problems.withColumn("constraints", F.lit("").cast("string"))
    asked = settled(proposals.split_constraints(told))
    routes = settled(retrieval.route_cases(asked, cases, list(broad)))
    hits = settled(whole_retrieval(chunks, vectors, asked, routes, brought, k, inject))
    keywords = F.transform(tx.keywords(F.concat_ws(" ", "problem", "constraints")), F.lower)
    gaps = settled(retrieval.knowledge_gaps(asked.withColumn("keywords", keywords), hits))
    found = settled(retrieval.conflicts(hits))
    spark = problems.sparkSession
    kind = asked.schema["query_id"].dataType.simpleString()
    nodes, links = spark.createDataFrame([], f"query_id {kind}, at int, id string, type string, source string"), spark.createDataFrame([], f"query_id {kind}, at int, source string, target string, type string")
    contexts = proposals.whole_context(hits, nodes, links, gaps)
    topics = asked.select("query_id", F.posexplode(keywords).alias("at", "topic"))
    prompts = settled(proposals.whole_prompts(asked, contexts, retrieval.all_hints(asked, routes, cases), found, topics))
    made = proposals.generate(told, hits, samples, reviews)
    ordered = made["hypotheses"]
    if folder is not None:
        stores.save_runs(ordered, folder)
        ordered = stores.read(spark, folder, "run_id")
    return made | {"hits": hits, "gaps": gaps, "conflicts": found, "prompts": prompts, "hypotheses": ordered}
