"""Golden examples for the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lithos.functions import text as tx
from lithos.operators import business, chunking, citations, evaluation, feedback, graphs, hypotheses, judging, model, proposals, retrieval, tables
from lithos.sources import files
from lithos.sources import sql as stores


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def text(spark, f, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("t")).alias("v")).first()["v"]


def test_cleaning(spark):
    assert text(spark, tx.normalize, " a\r\nb\n\n\n\nc ") == "a\nb\n\nc"
    assert text(spark, tx.clean_ocr, "x\n%%%%%%%%%%%%a\nгод 2020") == "год 2020"
    assert text(spark, tx.quality, "short") == 0.0
    assert text(spark, tx.quality, "слово " * 20) == 1.0
    for t, pages, want in (("", 10, True), ("x" * 50, 5, True), ("x" * 5000, 10, False)):
        assert one(spark, tx.needs_ocr(F.col("t"), F.col("p")), t=t, p=pages) is want


def test_chunks(spark):
    got = text(spark, lambda c: chunking.chunk_array(c, 100, 20), "word " * 500)
    assert len(got) > 1 and all(len(x) <= 120 for x in got)
    assert text(spark, chunking.chunk_array, "") == [] and text(spark, chunking.chunk_array, None) == []
    assert text(spark, lambda c: chunking.chunk_array(c, 20, 0), "aaaa bbbb\n\ncccc dddd\n\neeee") == ["aaaa bbbb\n\ncccc dddd", "eeee"]
    assert text(spark, lambda c: chunking.chunk_array(c, 12, 4), "One two. Three four.") == ["One two.", "two.\nThree four."]


def test_keywords(spark):
    assert text(spark, lambda c: tx.keywords(c, 3), "Медь медь and Copper copper 1234 recovery again") == ["Медь", "Copper", "recovery"]
    assert text(spark, tx.kpi_label, "Повышение извлечения") == "извлечение / выход"
    assert text(spark, tx.kpi_label, "ab") == "целевой KPI"
    assert text(spark, tx.kpi_markers, "recovery of copper") == ["recovery", "copper", "извлечение"]
    assert text(spark, tx.parameters, "pH: 9.5, temperature 25, извлечение 80") == {"pH": 9.5, "temperature": 25.0, "metric": 80.0}
    assert text(spark, tx.is_measurable, "дозировка 0.3 кг/т") and not text(spark, tx.is_measurable, "без чисел")
    assert text(spark, tx.ph_values, "pH 8-10, затем pH 7,5") == [7.5]
    assert [tuple(r) for r in text(spark, tx.ph_ranges, "pH 10–8 и pH 3-4")] == [(8.0, 10.0), (3.0, 4.0)]
    assert text(spark, tx.parse_number, "-12,5 кг") == 12.5 and text(spark, tx.parse_number, "нет") is None


def test_overlap(spark):
    pair = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert pair(citations.citation_overlap, "оптимизация pH и сернистый натрий", "Показана оптимизация pH и сернистый натрий в цикле") == 1.0
    assert pair(citations.citation_overlap, "浮选铜矿", "研究浮选铜矿的方法") >= 0.5
    assert pair(citations.citation_overlap, "совсем другое дело", "ничего общего здесь") < 0.3
    assert pair(citations.citation_overlap, "", "x") == 0.0
    body = "Начало текста. " + "слова разные идут " * 30 + "нужная цитата про депрессант стоит здесь. Конец."
    got = citations.best_windows(spark.createDataFrame([(1, "нужная цитата про депрессант", body)], "pair_id int, snippet string, corpus string"), 100).first()
    assert "нужная цитата про депрессант" in got["excerpt"] and got["score"] == 1.0


TAILINGS = [["", "Отвальные хвосты", "5824591", "0.17"], ["Класс крупности", "доля"], ["+71", "10", "20"], ["", "-10", "30", "40"], ["", "Итого извлекаемый металл", "", "72.78", "7564"], ["Итого", ""], ["+5", "1"]]


def sheet(spark, rows):
    return spark.createDataFrame([("w", "s", i, r) for i, r in enumerate(rows)], "workbook string, sheet string, row_idx int, cells array<string>")


def test_tables(spark):
    lines = [r["line"] for r in tables.kpi_summary(sheet(spark, TAILINGS)).orderBy("at").collect()]
    assert lines[:2] == ["- Итого извлекаемый металл в хвостах: 72.78%", "- Отвальные хвосты: 5824591 т"]
    assert lines[2:] == ["- +71 мкм: доля класса 10%, метрика 20", "- -10 мкм: доля класса 30%, метрика 40"]
    generic = sheet(spark, [["Дата", "Показатель", "Значение"], ["2020", "ток", "5"], ["2021", "ход", "7"]])
    over = tables.sheet_overview(generic).first()
    assert over["columns"] == ["Дата", "Показатель", "Значение"] and over["samples"] == ["ток: 5", "ход: 7"]
    assert [text(spark, tables.cell_text, v, "t double") for v in (None, 3.0, 0.123456, 12345.6)] == ["", "3", "0.1235", "1.235e+04"]


def test_experiments(spark):
    rows = [["sample_id", "pH", "reagent_dosage_kg_t", "temperature_C", "recovery_pct"], ["A1", "8.0", "0.5", "22", "78.2"], ["", "9,0", "0.3", "24", "84.5"], ["A9", "9", "0.1", "24", "n/a"]]
    got = tables.experiment_rows(sheet(spark, rows)).orderBy("row_idx").collect()
    assert [(r["sample_id"], r["pH"], r["recovery_pct"]) for r in got] == [("A1", 8.0, 78.2), ("row_2", 9.0, 84.5)]
    assert tables.experiment_rows(sheet(spark, [["a", "b"], ["1", "2"]])).count() == 0


DEMO = [(8.0, 0.5, 22, 78.2), (8.5, 0.4, 23, 80.1), (9.0, 0.3, 24, 84.5), (9.5, 0.35, 25, 83.0), (8.0, 0.6, 22, 76.5), (9.0, 0.25, 24, 86.2), (10.0, 0.3, 25, 81.0), (8.5, 0.45, 23, 79.8)]


def test_ridge(spark):
    df = spark.createDataFrame([tuple(map(float, r)) for r in DEMO], "ph double, dosage double, temperature double, recovery double")
    m = model.ridge(df, "recovery", ["ph", "dosage", "temperature"]).first()
    raw = [c / s for c, s in zip(m["coefficients"], m["scales"])]
    assert raw == pytest.approx([-1.17890744, -22.26494852, 0.6897898], abs=1e-6)
    assert m["intercept"] - sum(c * x for c, x in zip(raw, m["means"])) == pytest.approx(84.10838501, abs=1e-5)
    assert (m["r2"], m["baseline"]) == (pytest.approx(0.87267231, abs=1e-7), pytest.approx(80.55))
    assert model.ridge(df.limit(3), "recovery", ["ph"]).count() == 0
    none = model.predict(df, model.ridge(df.limit(0), "recovery", ["ph"]), F.array("ph")).first()
    assert none["predictive"] == 0.45 and none["predicted"] is None


def test_json_repair(spark):
    raws = [(1, 1, '```json\n{"text": "a", "novelty_score": 7}\n```'), (1, 2, 'Вот: {"hypotheses": [{"text": "b"}, {"text": "c"}]} так'), (1, 3, '{"text": "d\ne"}'), (1, 4, "null"), (1, 5, "{broken")]
    got = hypotheses.items(spark.createDataFrame(raws, "run_id int, sample_no int, raw string")).select("sample_no", "item.text").collect()
    assert {(r["sample_no"], r["text"]) for r in got} == {(1, "a"), (2, "b"), (2, "c"), (3, "d\ne")}


def test_roadmap(spark):
    assert text(spark, hypotheses.roadmap_from_text, "a; b\nc") == ["a", "b", "c"]
    assert len(text(spark, hypotheses.roadmap_from_text, "only")) == 2 and text(spark, hypotheses.roadmap_from_text, " ; ") is None
    h = spark.createDataFrame([(1, "t", ["Step 1: Пилот 14 дней на пробах 1 кг", "шаг 2: проверка, 2 недели. Успех: увеличение на 3%. Провал: нет"])], "hyp_id int, text string, roadmap array<string>")
    s = business.structured_roadmap(h).orderBy("step_order").collect()
    assert [r["duration_days"] for r in s] == [14, 14] and s[1]["success_criteria"] == "увеличение на 3%" and s[1]["depends_on"] == [1]
    steps = spark.createDataFrame([(1, 1, "A", 7, ["x"], []), (1, 2, "B", 14, ["x", "y"], [1])], "hyp_id int, step_order int, title string, duration_days int, resources array<string>, depends_on array<int>")
    total = business.roadmap_summary(steps).first()
    assert (total["total_days"], total["estimated_cost"], total["entry_points"], total["resources_unique"]) == (21, 15000 + 30000 + 8000 * 3, 1, ["x", "y"])
    assert [r["start_day"] for r in business.timeline(steps).orderBy("step_order").collect()] == [0, 7]
    orders = spark.createDataFrame([(1, [2, 1])], "hyp_id int, new_order array<int>")
    assert business.reorder(steps, orders).orderBy("step_order").first()["title"] == "B"


def test_economics(spark):
    got = spark.range(1).select(business.economics(F.lit(3.0), F.lit(7.0), F.lit("recovery"), F.lit(True)).alias("e")).first()["e"]
    assert (got["revenue"], got["savings"], got["capex"]) == (1_500_000.0, 500_000.0, 150_000.0)
    assert one(spark, business.expected_delta(F.lit("Повысить плотность с 30% до 35%, увеличит извлечение на 3%"), F.lit(5.0))) == 3.0


GOOD = dict(text="Снижение pH с 10 до 9 повысит извлечение меди на 3 % за счёт режима", mechanism="меньше депрессии минералов меди", reasoning="Согласно источнику, в отличие от типового режима, извлечение растёт", novelty=7.0, feasibility=8.0, expected_value=8.0, risk_technical=3.0, risk_economic=2.0, sources=[("d1", "цитата из источника, длинная")], roadmap=["лабораторные пробы 1 кг", "контроль: успех 3 %"])
SCHEMA = "hyp_id int, run_id string, text string, mechanism string, reasoning string, novelty double, feasibility double, expected_value double, risk_technical double, risk_economic double, sources array<struct<doc_id:string,snippet:string>>, roadmap array<string>"


def test_checks(spark):
    bad = GOOD | dict(text="коротко", risk_technical=5.0, risk_economic=5.0, sources=[], roadmap=[])
    h = spark.createDataFrame([(1, "r", *GOOD.values()), (2, "r", *bad.values())], SCHEMA)
    checked = judging.checks(h, F.lit("извлечение меди"))
    failed = {(r["hyp_id"], r["key"]) for r in checked.filter("NOT passed").collect()}
    assert not {k for i, k in failed if i == 1}
    assert {k for i, k in failed if i == 2} == {"testable_formulation", "sources", "risks", "roadmap_steps", "roadmap_resources", "roadmap_criteria"}
    c = {r["hyp_id"]: r for r in judging.compliance(checked).collect()}
    assert c[1]["compliance_pct"] == 100.0 and c[2]["mandatory_passed"] == 4
    issues = judging.constraint_issues(h, F.lit("pH 8-9.5")).collect()
    assert not issues  # "pH с 10" states no value
    outside = h.withColumn("text", F.lit("при pH 10 и pH 3-4"))
    assert {(r["kind"], r["low"]) for r in judging.constraint_issues(outside.limit(1), F.lit("pH 8-9.5")).collect()} == {("value", 10.0), ("range", 3.0)}


def test_run_index(spark):
    v = spark.createDataFrame([("a", True, 10.0, True), ("a", True, 10.0, True), ("b", False, 0.0, False)], "run_id string, approved boolean, overall_score double, source_grounded boolean")
    assert {r["run_id"]: r["run_index"] for r in judging.run_index(v).collect()} == {"a": 100.0, "b": 0.0}


def test_graphs(spark):
    links = spark.createDataFrame([(1, "A", "B", "X", 0), (1, "a", "b ", "X", 1), (1, "A", "a", "X", 2)], "hyp_id int, source string, target string, type string, at int")
    assert graphs.distinct_links(links).count() == 1
    h = spark.createDataFrame([(1, ["лаборатория", "пилот", "внедрение в пром"]), (2, None)], "hyp_id int, roadmap array<string>")
    states = graphs.roadmap_states(h)
    got = states.orderBy("at").collect()
    assert len(got) == 3 and [r["phase_order"] for r in got] == [1, 2, 3] and got[1]["from_id"] == got[0]["id"]
    nodes = spark.createDataFrame([(1, "k", "Property", "d"), (1, "m", "Material", None), (1, "p", "Process", None)], "hyp_id int, id string, type string, source_doc_id string")
    measured = graphs.graph_measures(h, nodes, links, states).withColumn("n_sources", F.lit(1))
    valid = {r["hyp_id"]: (r["valid"], len(r["issues"])) for r in graphs.validate(measured).collect()}
    assert valid == {1: (True, 0), 2: (False, 6)}
    assert {r["hyp_id"]: round(r["c"], 2) for r in measured.select("hyp_id", graphs.completeness().alias("c")).collect()} == {1: 1.0, 2: 0.0}


def test_feedback(spark):
    w = {"novelty": 0.3, "feasibility": 0.25, "expected_value": 0.3, "risk": 0.15}
    up = feedback.stepped(w, "confirmed", None, {"novelty": 9, "risk": 3})
    assert up["novelty"] > w["novelty"] and sum(up.values()) == pytest.approx(1)
    assert feedback.stepped(w, "rejected", {"novelty": 2}, {})["novelty"] < w["novelty"]
    e = spark.createDataFrame([(2, 2, "t", "rejected", 9.0, None), (1, 1, "t", "confirmed", 9.0, 8.0), (3, 3, "u", "needs_review", None, None)], "event_id int, ts int, tenant string, status string, novelty double, feasibility double").withColumns({"expected_value": F.lit(None).cast("double"), "risk": F.lit(None).cast("double")})
    got = {r["tenant"]: r for r in feedback.fold_weights(e).collect()}
    want = feedback.stepped(feedback.stepped(w, "confirmed", None, {"novelty": 9, "feasibility": 8}), "rejected", None, {"novelty": 9})
    assert got["t"]["n"] == 2 and got["t"]["novelty"] == pytest.approx(want["novelty"]) and got["u"]["novelty"] == pytest.approx(0.3)


def test_retrieval(spark):
    hits = spark.createDataFrame([("q", i, i, f"text {i % 2} " + "words of some length " * 3, 1.0 - i / 10, i + 1) for i in range(4)], "query_id string, doc_id int, chunk_index int, text string, score double, rank int")
    assert [r["doc_id"] for r in retrieval.dedupe_prefix(hits).orderBy("rank").collect()] == [0, 1]
    chunks = spark.createDataFrame([(0, i, "a text that is long enough to count") for i in range(4)], "doc_id int, chunk_index int, text string")
    around = retrieval.expand_neighbours(spark.createDataFrame([("q", 0, 1, 1)], "query_id string, doc_id int, chunk_index int, rank int"), chunks, 5)
    assert [r["chunk_index"] for r in around.orderBy("rank").collect()] == [1, 0, 2]
    extra = spark.createDataFrame([("q", 9, 0, "t", 1.0, "brainstorm", 1.0), ("q", 8, 0, "t", 1.0, "kpi", 1.0), ("q", 7, 0, "t", 1.0, None, 1.0)], "query_id string, doc_id int, chunk_index int, text string, score double, kind string, example_score double")
    assert [r["doc_id"] for r in retrieval.inject(hits, extra, 3, 4).orderBy("rank").collect()] == [8, 9, 7, 0]
    cited = spark.createDataFrame([("c1", "q", "0"), ("c2", "q", "zz")], "citation_id string, query_id string, cited_id string")
    named = {r["citation_id"]: r["resolved"] for r in citations.resolve_doc_ids(cited, hits.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()}
    assert named == {"c1": "0", "c2": None}


def test_topics(spark):
    docs = spark.createDataFrame([(1, "1. Первая тема\n2) вторая\nбез номера\n## Пункт 3: третья\n| 4. четвёртая | x |\n1. первая ТЕМА")], "doc_id int, text string")
    got = evaluation.numbered_topics(docs)
    assert [(r["number"], r["topic"]) for r in got.orderBy("at").collect()][:4] == [("1", "Первая тема"), ("2", "вторая"), ("3", "третья"), ("4", "четвёртая")]
    assert evaluation.distinct_topics(got).count() == 4
    topics = spark.createDataFrame([("c", "оптимизация помола"), ("c", "совсем иное направление")], "case_id string, topic string")
    assert evaluation.topic_recall(topics, spark.createDataFrame([("c", "предложена оптимизация помола руды")], "case_id string, text string")).first()["recall"] == 0.5


def test_sql_source(spark):
    spark.createDataFrame([(9, 85)], "pH int, recovery_pct int").createOrReplaceTempView("t_lab")
    assert stores.sql_rows(spark, "SELECT * FROM t_lab;").count() == 1
    for bad in ("DELETE FROM t_lab", "SELECT 1; DROP TABLE t_lab", "select * from t_lab where drop = 1"):
        with pytest.raises(ValueError):
            stores.checked(bad)


def test_point_key(spark):
    import uuid

    got = spark.range(5).select(stores.point_key(F.col("id"), F.lit(3)).alias("k")).collect()
    assert [r["k"] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{i}:3")) for i in range(5)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("привет".encode())
    (tmp_path / "b.md").write_bytes("привет".encode("cp1251"))
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "processed").mkdir()
    (tmp_path / "processed" / "d.txt").write_bytes(b"skip")
    assert files.list_files(spark, str(tmp_path)).count() == 2
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"][0] == got["b.md"][0] == "привет" and got["c.bin"] == (None, "unsupported: bin")


def test_entry_without_training_folder():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark):
    """Native operators have no Python node; filters and columns reach the scan."""
    from lithos.plans import record_queries, text_queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for f in (text_queries.t03, text_queries.t11, record_queries.j14, record_queries.b14):
        text_ = plan(f(spark, "/root/testdata/sf0.001"))
        assert "Python" not in text_ and "Arrow" not in text_ and "CartesianProduct" not in text_
    scan = plan(text_queries.t03(spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan


def test_whole_retrieval(spark, tmp_path):
    from lithos.plans import proposal_queries

    r = random.Random(3)
    word = lambda: "".join(r.choice("abdefghklmnopqrsuvw") for _ in range(r.randrange(3, 9)))
    docs = [(100 + i, " ".join(word() for _ in range(n)), f"src{i}", "en") for i, n in enumerate([900, 30, 40, 50])]
    docs.append((105, "12 .", "src1", "en"))  # no first-stage hit, for its quality; its case brings it
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, i / 2], 0) for i in range(2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, 0, "plain"), (7, 0, "los os alle"), (7, 1, "x")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(x) for x in proposal_queries.r17(spark, str(tmp_path)).collect()]
    whole = {(x["doc_id"], x["chunk_index"]) for x in chunking.chunks(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")).collect()}
    assert len(whole) > 6 and {g[0] for g in got} == {0, 7}
    assert {g[1:3] for g in got if g[0] == 0} == whole - {(105, 0)} and {g[1:3] for g in got if g[0] == 7} == whole
    assert [g[3] for g in got if g[:3] == (7, 105, 0)] == [1]


def test_analogies_of_all_hypotheses(spark, tmp_path):
    from lithos.plans import proposal_queries

    r = random.Random(4)
    docs = [(i, " ".join("".join(r.choice("abdefghklm") for _ in range(8)) for _ in range(40)), f"src{i}", "en") for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [math.cos(i), math.sin(i)], 0) for i in range(7)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, i * 3, "1-URGENT") for i in range(1, 31)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = proposal_queries.b05(spark, str(tmp_path)).collect()
    assert sorted(x["hyp_id"] for x in got) == list(range(1, 31)) and {x["score"] for x in got} == {18}
    assert len({x["doc_id"] for x in got}) > 1


def test_analysis(spark):
    hyps = spark.createDataFrame([(1, "a", "pH 9 recovery 5"), (2, "a", "nothing"), (3, "b", "pH 9")], "hyp_id int, query_id string, text string")
    hits = spark.createDataFrame([("a", "pH 8"), ("a", "pH 7"), ("c", "pH 7")], "query_id string, text string")
    gaps = spark.createDataFrame([("b", "high"), ("a", "medium")], "query_id string, severity string")
    assert {tuple(x) for x in proposals.analysis(hyps, hits, gaps).collect()} == {(1, 0.65), (2, 0.45), (3, 0.39)}


def test_aligned_candidates(spark, tmp_path):
    from lithos.plans import text_queries

    passage = "the quick brown fox met nine old grey cats on that wet day and they all ran far from it into a red barn"
    docs = [(1, "then " + passage.replace("the quick brown", "some slow white") + " end"), (2, passage[40:80] + " and more"), (3, "no word of this is shared"), (None, passage), (None, passage + " x"), (5, "ok"), (6, "so ok then"), (7, "Elsewhere")]
    spark.createDataFrame([(i, x, "s", "en") for i, x in docs], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "ok")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["pair_id"]: x["overlap"] for x in text_queries.c08(spark, str(tmp_path)).collect()}
    assert set(got) == {"1-1", "1-2", "1-null", "1-null-2", "2-5", "2-6"} and got["1-null"] == got["1-null-2"] == 1.0 and got["1-1"] > 0.5


def test_processed_documents(spark, tmp_path):
    """The newest version of each id is written and read back; broken files and other sources are left out."""
    from lithos.sources import files

    meta = lambda s: F.struct(F.lit("t").alias("title"), F.lit(s).alias("source"))
    docs = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "text", 1)], "id string, text string, version int").withColumns({"path": F.col("id"), "metadata": F.when(F.col("id") == "a", meta("Folder/A")).otherwise(meta("else"))})
    folder = str(tmp_path / "docs")
    files.write_processed(docs, folder)
    (tmp_path / "docs" / "broken.json").write_text("{ no json")
    assert {(r["id"], r["text"]) for r in files.processed(spark, folder).collect()} == {("a", "new"), ("b", "text")}
    assert [r["id"] for r in files.processed(spark, folder, ["folder/a"]).collect()] == ["a"]
    assert files.processed(spark, folder, most=1).count() == 1
