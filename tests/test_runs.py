"""A whole run from the tables, stored and read back; analogies in words."""

from pyspark.sql import functions as F

from lithos.operators import lineage, proposals, runs
from lithos.plans import state_queries


def test_whole_run(spark):
    out = state_queries.whole_run(spark, "/root/testdata/sf0.001", lineage.fresh(spark, "runs"))
    hits = out["hits"].collect()
    assert hits and all(r["score"] is not None for r in hits) and any(r["is_example"] for r in hits) and any(r["expanded"] for r in hits)
    ranks = {}
    for r in hits:
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 16 for v in ranks.values())
    prompts = {r["query_id"]: r["prompt"] for r in out["prompts"].collect()}
    assert set(prompts) == set(ranks) and all("Target problem:" in p and "doc_id=" in p for p in prompts.values())
    h = out["hypotheses"].collect()
    assert {r["run_id"] for r in h} == set(prompts) and {r["approved"] for r in h} == {True, False}
    grounded = {r["source_grounded"] for r in h}
    assert grounded == {True, False}
    for run in prompts:
        own = sorted((r["rank"], r["approved"]) for r in h if r["run_id"] == run)
        assert [r for r, _ in own] == list(range(1, len(own) + 1)) and [a for _, a in own] == sorted((a for _, a in own), reverse=True)


def test_analogy_texts(spark):
    hyps = spark.createDataFrame([(1, "q", "Flotation of copper at pH 9", "m"), (2, "r", "abc", "reagents"), (3, "s", "abc", None), (4, "none", "abc", None)], "hyp_id int, query_id string, text string, mechanism string")
    hits = spark.createDataFrame([("q", 2, "d2", "Grinding and flotation circuits at pH 9.1"), ("q", 1, "d1", "no"), ("r", 1, "e1", "two of"), ("r", 2, "e2", "the Reagents"), ("s", 1, "f1", "ab")], "query_id string, rank int, doc_id string, text string")
    topics = "flotation|grinding|circuits"  # so that a hit may have none
    got = {r["hyp_id"]: r for r in proposals.analogy_texts(hyps, hits, topics).collect()}
    assert (got[1]["kind"], got[1]["doc_id"]) == ("topic", "d2") and got[1]["analogy"].startswith("Cross-domain аналогия (перенос из домена «circuits»): в d2… описан похожий механизм (")
    assert got[1]["analogy"].endswith(" — «Grinding and flotation circuits at pH 9.1…»")
    assert (got[2]["kind"], got[2]["doc_id"], got[2]["analogy"]) == ("token", "e2", "Аналогия по параметру «reagents» в e2…: «the Reagents…»")
    assert got[3]["kind"] == got[4]["kind"] == "general" and got[3]["analogy"].startswith("Аналогия: механизм сопоставим")
    assert proposals.analogy_texts(hyps, hits.limit(0)).filter(F.col("kind") != "general").count() == 0


def test_corpus_graph(spark):
    docs = spark.createDataFrame(
        [(1, "A", "s1", "about flotation", []), (2, None, "s2", "nothing", []), (3, "C", "s3", "Итого извлекаемый металл, доля 72,5 и flotation", ["enterprise_kpi"]), (4, "D", "flotation.txt", None, None)],
        "doc_id long, title string, source string, text string, tags array<string>",
    )
    metrics = spark.createDataFrame(
        [(1, 0, "pH", "9", "process_parameters"), (1, 1, "flotation_time", "5", "process_parameters"), (1, 2, "recoverable_metal_pct", "80", "measurement_results"), (3, 0, "flotation_time", "5", "process_parameters"), (3, 1, "mode", None, "process_parameters"), (2, 0, "pH", "9", "process_parameters")],
        "doc_id long, at int, key string, value string, bucket string",
    )
    nodes, links = proposals.whole_corpus_graph(docs, metrics, ["Flotation"])
    assert [(r["id"], r["type"]) for r in nodes.orderBy("at").collect()] == [("doc:1", "Publication"), ("KPI recovery 80%", "Property"), ("flotation_time=5", "Parameter"), ("doc:3", "Publication"), ("KPI 2,5%", "Property"), ("doc:4", "Publication")]
    got = [(r["source"], r["target"], r["type"]) for r in links.orderBy("at").collect()]
    assert got[:3] == [("doc:1", "KPI recovery 80%", "REPORTS"), ("doc:1", "flotation_time=5", "CITED_BY"), ("doc:3", "flotation_time=5", "CITED_BY")] and len(got) == 4
    first = proposals.whole_corpus_graph(docs, metrics, ["Flotation"], first_only=True)[1]
    assert [(r["source"], r["target"]) for r in first.orderBy("at").collect()][:2] == [("doc:1", "KPI recovery 80%"), ("doc:1", "flotation_time=5")] and first.count() == 3
    assert proposals.whole_corpus_graph(docs, metrics, ["Flotation"], most=2)[0].count() == 2 and proposals.whole_corpus_graph(docs.limit(0), metrics, ["x"])[0].count() == 0
