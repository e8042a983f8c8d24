"""What the findings of the third round named."""

from lithos.operators import citations, hypotheses, proposals, retrieval
from lithos.plans import record_queries


def test_merged_graphs_with_keys_that_reach_into_the_graph_number(spark, tmp_path):
    """r21_merge_graphs: its SQL packs size and key into one number, so that a key of 100000 and more counts as a later graph."""
    rows = [(1, 5), (100501, 4), (501, 6), (2, 7), (1000002, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in record_queries.QUERIES["r21_merge_graphs"](spark, str(tmp_path)).collect()}
    plain = {}
    for key, size in rows:
        plain[key % 500] = min(plain.get(key % 500, 1 << 60), size * 100000 + key)
    assert got == {(k, v % 100000) for k, v in plain.items()}


def test_aliases_of_one_keyword_stand_in_the_order_of_their_table(spark):
    words = spark.createDataFrame([(1, 0, "orderation"), (1, 1, "plain")], "query_id int, at int, word string")
    aliases = spark.createDataFrame([(0, "tion", "ending"), (1, "der", "article")], "place int, term string, alias string")
    got = [r.word for r in retrieval.expand_keywords(words, aliases).orderBy("rank").collect()]
    assert got == ["orderation", "ending", "article", "plain"]


def test_hits_are_placed_and_injected_without_their_texts(spark):
    """r17_retrieve: texts went through every sort and join; now what counts of a text stands for it, with the same outcome."""
    long = "the recovery of metal in tailings rises with grinding and flotation time as measured in the plant "
    rows = [(q, d, 0, 0.5 + 0.01 * d, d + 1, (long * 3 if d % 3 else "x") + ("" if d % 4 == 0 else str(d)), ["metal", "plant"]) for q in (1, 2) for d in range(8)]
    rows += [(3, d, 0, 0.5, d + 1, "y", ["metal"]) for d in range(7)]
    hits = spark.createDataFrame(rows, "query_id int, doc_id int, chunk_index int, score double, rank int, text string, keywords array<string>")
    chain = retrieval.dedupe_prefix(retrieval.drop_low_quality(retrieval.rerank(hits)))
    few = retrieval.best_of_few(hits)
    assert "text" not in few.columns
    names = ["query_id", "doc_id", "rank", "rerank_score"]
    assert few.select(names).orderBy("query_id", "rank").collect() == chain.select(names).orderBy("query_id", "rank").collect()
    extra = spark.createDataFrame([(1, 90, 0, "a", 1.0, "kpi", 1.0), (1, 91, 0, "извлекаемый металл в хвостах", 1.0, "kpi", 1.0)], "query_id int, doc_id int, chunk_index int, text string, score double, kind string, example_score double")
    whole = retrieval.inject(chain, extra, 3, 4).select("query_id", "rank", "doc_id")
    assert retrieval.inject(few, extra, 3, 4).select("query_id", "rank", "doc_id").orderBy("query_id", "rank").collect() == whole.orderBy("query_id", "rank").collect()


def test_alike_citations_are_aligned_once(spark, monkeypatch):
    """c10_clean_sources: each citation was aligned for itself, with its document's text beside it."""
    corpus = "grinding raises the recovery of metal from tailings when the pulp is kept at a steady density. " * 5
    hits = spark.createDataFrame([("q", "doc", 1, corpus)], "query_id string, doc_id string, rank int, text string")
    cited = spark.createDataFrame([(f"h{i}", "q", 0, "doc", "grinding zzzz qqqq wwww vvvv uuuu") for i in range(40)], "hyp_id string, query_id string, at int, cited_id string, snippet string")
    met, plain = [], citations.align
    monkeypatch.setattr(citations, "align", lambda pairs, *a: met.append(pairs.count()) or plain(pairs, *a))
    got = hypotheses.clean_sources(cited, hits).select("hyp_id", "snippet").collect()
    assert met == [1] and len(got) == 40 and len({r.snippet for r in got}) == 1 and got[0].snippet in corpus


def test_long_work_on_few_bytes_is_dealt_out(spark):
    """h19_generate and c08_align: samples are parsed, and pairs aligned, in many tasks however few bytes they have."""
    samples = spark.createDataFrame([("r", i, '{"text": "t"}') for i in range(50)], "run_id string, sample_no int, raw string").coalesce(1)
    assert hypotheses.items(samples).rdd.getNumPartitions() >= 16
    pairs = spark.createDataFrame([(i, "a b c", "a b c d") for i in range(50)], "pair_id int, snippet string, corpus string").coalesce(1)
    assert citations.align(pairs).rdd.getNumPartitions() >= 16


def test_analogies_of_alike_hypotheses_are_scored_once(spark):
    """b05_analogies: every hypothesis met every hit of its query, though few wordings differ."""
    hyps = spark.createDataFrame([(i, 1, "grinding improves recovery") for i in range(200)] + [(900, 1, "density matters") , (901, 1, None)], "hyp_id int, query_id int, text string")
    hits = spark.createDataFrame([(1, 1, 7, "grinding circuits density"), (1, 2, 8, "flotation reagent dosage")], "query_id int, rank int, doc_id int, text string")
    found = proposals.analogies(hyps, hits)
    got = {r.hyp_id: (r.doc_id, r.score) for r in found.collect()}
    assert len(got) == 201 and len({got[i] for i in range(200)}) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" in plan and plan.index("Aggregate [hyp_id") < plan.index("Aggregate [query_id")
