"""What a query shuffles, writes and sorts does not outgrow its input; the results are those of the longer ways."""

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithos.functions import text as tx
from lithos.operators import business, chunking, graphs, hypotheses, judging, proposals, ranks
from lithos.plans import tables
from lithos.sources import stores
from lithos.streaming import flows


def test_an_ingested_batch_writes_its_own_rows_alone(spark, tmp_path):
    """each batch read, shuffled twice and wrote twice all that its buckets had."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda where="in", cp="cp": flows.ingest_stream(spark, str(tmp_path / where), "doc_id long, text string, source string", out, str(tmp_path / cp)).awaitTermination()
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    key = lambda df: sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in df.collect())
    first, second = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1")
    first.write.mode("append").parquet(inbox)
    run()
    before = files()
    second.unionByName(second).unionByName(first.filter("doc_id < 30")).write.mode("append").parquet(inbox)  # twice in a batch, and known ones
    run()
    assert before.items() <= files().items()  # what the first batch wrote lies as it was
    assert key(spark.read.parquet(out)) == key(chunking.chunks(docs.filter("doc_id % 3 < 2")))
    last = max((p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()  # the last batch again
    assert before.items() <= files().items()
    assert key(spark.read.parquet(out)) == key(chunking.chunks(docs.filter("doc_id % 3 < 2")))
    docs.write.parquet(str(tmp_path / "other"))
    run("other", "cp_other")  # another stream into the same table
    assert key(stores.read(spark, out, "bucket", "int")) == key(chunking.chunks(docs))


def test_new_rows_in_pieces(spark, tmp_path, monkeypatch):
    """buckets of many rows are dealt out in pieces; null keys are keys, and rows without content leave no mark."""
    monkeypatch.setattr(stores, "PIECE", 5)
    folder = str(tmp_path / "t")
    rows = spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    stores.add_new(rows, folder, ["k"], "a-0", lambda new: new.filter("k = -1"), 4)
    stores.add_new(rows.filter("k IS NULL OR k < 150"), folder, ["k"], "a-1", buckets=4)
    stores.add_new(rows, folder, ["k"], "a-2", buckets=4)
    stores.add_new(rows.limit(0), folder, ["k"], "a-3", buckets=4)
    got = stores.read(spark, folder, "bucket", "int").select("k", "v", "batch").collect()
    assert sorted((r["k"] or 0, r["v"]) for r in got) == [(i, f"v{i}") for i in range(200)]
    assert {r["batch"] for r in got if r["k"] is None or r["k"] < 150} == {"a-1"} and {r["batch"] for r in got if (r["k"] or 0) >= 150} == {"a-2"}


def test_checks_are_counted_in_the_row(spark):
    """each hypothesis became ten rows that were dealt out, and its own row went through a join."""
    h = tables.hypotheses(spark, "/root/testdata/sf0.001").filter("hyp_id < 400").withColumns({"graph_issues": F.when(F.col("hyp_id") % 3 == 0, F.array(F.lit("Рекомендация: x"))).when(F.col("hyp_id") % 3 == 1, F.array(F.lit("x"))), "business_case": F.lit(None).cast("struct<target_kpi:string,delta_pct:double,revenue:double,narrative:string>")})
    for table in (judging.CHECKS, judging.WHOLE_CHECKS):
        long = judging.compliance(judging.checks(h, F.lit("recovery of metal"), table))
        own = judging.with_compliance(h, F.lit("recovery of metal"), table)
        assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in own.select(*long.columns).collect()} == {tuple(r) for r in long.collect()}


def test_places_in_large_groups_take_one_deal(spark, monkeypatch):
    """rows that were sorted already were dealt out and sorted again for their places; both ways beside few and many groups."""
    df = spark.range(3000).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    want = {(r["g"], r["v"]): r["n"] for r in df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v"))).collect()}
    for most in (0, 100_000):
        monkeypatch.setattr(ranks, "STARTS", most)
        got = ranks.ranked_wide(df, ["g"], [F.asc("v")])
        assert {(r["g"], r["v"]): r["rank"] for r in got.collect()} == want and got.columns == ["g", "v", "rank"]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_an_output_is_parsed_once(spark):
    """a list, the object itself, both within words and fences, broken, of wrong kinds, and with control characters."""
    raws = [
        '{"hypotheses": [{"text": "a", "novelty_score": 3}, {"text": "b"}]}', '{"text": "c", "novelty_score": "x"}', '{"hypotheses": {"text": "d"}}', '{"hypotheses": 5, "text": "e"}', '{"hypotheses": [], "text": "f"}',
        '```json\n{"text": "g\th"}\n```', 'So: {"hypotheses": [{"text": "i"}]} as asked', "no", "{broken", None, '{"mechanism": "m"}', '{"hypotheses": null, "text": "j", "risk": {"technical": 1}}', '  {"text": "k"}\n',
    ]
    samples = spark.createDataFrame([("r", i, r) for i, r in enumerate(raws)], "run_id string, sample_no int, raw string")
    listed = hypotheses.parse_json(F.col("raw"), f"hypotheses array<struct<{hypotheses._colons(hypotheses.RAW)}>>")["hypotheses"]
    single = hypotheses.parse_json(F.col("raw"), hypotheses.RAW)
    own = F.when(listed.isNotNull(), listed).when(single["text"].isNotNull(), F.array(single))
    twice = samples.select("run_id", "sample_no", F.posexplode(own).alias("at", "item"))
    key = lambda df: sorted((r["sample_no"], r["at"], str(r["item"])) for r in df.collect())
    once = hypotheses.items(samples)
    assert key(once) == key(twice) and len(key(once)) > 6
    assert once._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


def test_words_are_found_before_patterns(spark):
    texts = spark.createDataFrame([("ПРОБА",), ("проба",), ("5 л воды",), ("слон",), ("",), (None,)], "t string")
    for pattern in (judging._RESOURCES, judging._COMPARISON, judging._CRITERIA):
        assert all(a == b for a, b in texts.select(tx.matches_words(F.col("t"), pattern), tx.matches(F.col("t"), pattern)).collect())


def test_enrichment_by_wording_is_that_by_hypothesis(spark, monkeypatch):
    """nodes, links, states and steps were exploded, sorted and joined for each hypothesis, and patterns searched in each."""
    graph = """CASE hyp_id % 8 WHEN 0 THEN '{"nodes": ["A", "a", {"id": "b", "source_doc_id": "s"}, {"id": "K", "type": "Property"}], "links": [{"from": "A", "to": "b"}, {"source": "a", "target": "B"}, {"source": "b", "target": "b"}]}' WHEN 1 THEN '{"nodes": ["A"]}' END"""
    h = tables.hypotheses(spark, "/root/testdata/sf0.001").filter("hyp_id < 600").withColumns({
        "query_id": F.col("run_id"), "problem": F.expr("CASE WHEN hyp_id % 9 = 0 THEN 'депрессант пустой породы на флотации, известь, мельницы' ELSE 'recovery of metal' END"), "graph": F.expr(graph), "chunk_text": F.expr("CASE WHEN hyp_id % 7 = 1 THEN 'pH 9.5, ксантогенат, гидроциклон' END"),
        "mechanism": F.expr("CASE WHEN hyp_id % 10 = 1 THEN 'минералы пустой породы' WHEN hyp_id % 10 = 2 THEN NULL ELSE mechanism END"),
        "roadmap": F.expr("CASE WHEN hyp_id % 13 = 0 THEN NULL WHEN hyp_id % 13 = 1 THEN array() WHEN hyp_id % 13 = 2 THEN array('Шаг 1: опыт', NULL, 'опыт', '', 'a', 'b', 'c') ELSE roadmap END"),
    })
    hits = spark.createDataFrame([(str(i), 1, "pH 8, metric: 5 %") for i in range(20)], "query_id string, rank int, text string")
    gaps = spark.createDataFrame([("3", "high"), ("3", "high"), ("4", "low")], "query_id string, severity string")
    lines = business.roadmap_lines(business.structured_roadmap(h)).groupBy("hyp_id").agg(F.sort_array(F.collect_list(F.struct("step_order", "line")))["line"].alias("roadmap"))
    case = business.business_case(h, F.col("problem"), F.lit(True), F.size("sources"))
    case = case.select("hyp_id", F.struct(*[c for c in case.columns if c != "hyp_id"]).alias("business_case"))
    measures = graphs.graph_measures(h, *graphs.whole_graph(h)).join(h.select("hyp_id", F.size("sources").alias("n_sources")), "hyp_id")
    checked = graphs.validate(measures).select("hyp_id", F.col("issues").alias("graph_issues"), graphs.completeness().alias("completeness"))
    names = ("hyp_id", "roadmap", "predictive", "business_case", "graph_issues", "completeness")
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*names).collect())
    want = key(h.select("hyp_id").join(lines, "hyp_id").join(proposals.analysis(h, hits, gaps), "hyp_id").join(case, "hyp_id").join(checked, "hyp_id"))
    assert key(proposals.enriched(h, hits, gaps, F.lit(True))) == want and len(want) > 100
    monkeypatch.setattr(proposals, "WORDINGS", 0)
    assert key(proposals.enriched(h, hits, gaps, F.lit(True))) == want
    counts = [c for c in measures.columns if c.startswith("n_") and c not in ("n_sourced", "n_sources")]
    assert sorted(str(tuple(r)) for r in graphs.told_measures(h).select("hyp_id", *counts).collect()) == sorted(str(tuple(r)) for r in measures.select("hyp_id", *counts).collect())
