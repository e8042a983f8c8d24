"""Named queries over the driver's tables and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions import text as tx
from lithos.operators import chunking, retrieval

from . import case_queries, proposal_queries, record_queries, state_queries, text_queries
from .tables import table

_MODULES = (text_queries, record_queries, proposal_queries, case_queries, state_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval end to end: documents to chunks, benchmark passages as queries, keywords met as tokens, rerank, dedupe, the five best chunks and their documents."""
    chunks = chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.keywords(F.col("text")).alias("keywords"))
    asked = queries.select("query_id", F.explode("keywords").alias("w")).select("query_id", F.lower("w").alias("w"))
    tokens = chunks.select("doc_id", "chunk_index", F.explode(F.array_distinct(tx.all_of(F.lower("text"), tx.LETTERS + "{4,}"))).alias("w"))
    met = tokens.join(asked, "w").groupBy("query_id", "doc_id", "chunk_index").agg((F.count("*") / 15).alias("score"))
    first = retrieval.ranked(met, ["query_id"], [F.desc("score"), F.asc("doc_id"), F.asc("chunk_index")], 24)
    hits = first.join(chunks, ["doc_id", "chunk_index"]).join(queries, "query_id")
    best = retrieval.dedupe_prefix(retrieval.rerank(hits)).filter("rank <= 5")
    return best.select("query_id", "rank", "doc_id", "chunk_index", "rerank_score")
