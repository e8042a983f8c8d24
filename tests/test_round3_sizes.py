"""What the findings of the third round named at larger tables: same rows with less work."""

from pyspark.sql import functions as F

from lithos.operators import citations, graphs, hypotheses, model, tables


def test_wordings_that_differ_in_what_a_corpus_lacks_are_one_search(spark):
    """each wording of a hypothesis walked all windows of its document."""
    corpus = "grinding raises the recovery of metal from tailings when the pulp is kept at a steady density. " * 5
    rows = [(i, f"recovery zzzz qqqq at {i} wwww{i}", corpus, ["recovery", f"medium{i}"]) for i in range(30)]
    pairs = spark.createDataFrame(rows, "pair_id int, snippet string, corpus string, terms array<string>")
    f = citations.fitted(citations.prepared(F.col("snippet")), F.col("terms"), F.col("corpus"))
    assert pairs.select(F.to_json(f).alias("f")).distinct().count() <= 3  # sizes count, words that the corpus lacks do not
    best = citations.best_windows(pairs).collect()
    assert len(best) == 30 and {r.start for r in best} == {best[0].start} and all("recovery" in r.excerpt for r in best)
    none = spark.createDataFrame([(1, "zzzz qqqq wwww", corpus)], "pair_id int, snippet string, corpus string")
    got = citations.best_windows(none).first()
    assert (got.start, got.length, got.score, got.excerpt) == (0, 280, 0.0, "zzzz qqqq wwww")


def test_kpi_lines_of_workbooks_are_read_in_one_sort(spark):
    """Rows were sorted four times and dealt out seven."""
    cells = {1: ["Отвальные хвосты", "5", ""], 2: ["Итого извлекаемый металл", "7,5"], 3: ["Класс крупности", ""], 0: ["+9", "10", "2"]}
    rows = [(f"w{w}", "a" if n < 4 else "b", n, cells[n % 4]) for w in range(20) for n in range(1, 60) if w % 4 or n % 4 == 0]
    rows += [("w1", "c", 1, ["", ""]), ("w1", "d", 1, ["+71", "3"]), ("odd", "a", 1, None), ("odd", None, 2, ["Recovery, total", "x"])]
    r = spark.createDataFrame(rows, "workbook string, sheet string, row_idx int, cells array<string>")
    got = tables.workbook_kpi_summary(r)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    whole = tables.kpi_summary(tables.workbook_rows(r)).drop("sheet")
    assert sorted(got.collect()) == sorted(whole.collect()) and got.count() > 100
    lines = [x.line for x in tables.workbook_summary(r).filter("workbook = 'odd'").orderBy("part", "sheet", "at").collect()]
    assert lines[:2] == ["- Файл: odd, листов: 1", "## Обзор листов"]


def test_experiments_of_one_sheet_are_numbered_in_many_tasks(spark, monkeypatch):
    """a sheet's experiments were numbered in one task."""
    rows = [("w", "s", 0, ["Sample", "pH", "Reagent dosage", "Recovery, %"])] + [("w", "s", i, ["" if i % 2 else f"S{i}", f"{i},5", "", "n/a" if i % 5 == 0 else str(i)]) for i in range(1, 60)]
    rows += [("w", "s", 60, ["  ", None, "1", "7"]), ("w", "s", 60, ["T", "2", "", ""]), ("w", "s", 61, None)]
    met, plain = [], tables.ranked_wide
    monkeypatch.setattr(tables, "ranked_wide", lambda *a, **k: met.append(1) or plain(*a, **k))
    got = {r.row_idx: r for r in tables.experiment_rows(spark.createDataFrame(rows, "workbook string, sheet string, row_idx int, cells array<string>")).collect()}
    kept = [i for i in range(1, 60) if i % 5]
    assert met == [1] and sorted(got) == [*kept, 60]
    assert all(got[i].sample_id == (f"row_{kept.index(i) + 1}" if i % 2 else f"S{i}") for i in kept)
    assert (got[60].sample_id, got[60].pH, got[60].reagent_dosage, got[60].recovery_pct) == ("T", 2.0, 1.0, 7.0)


def test_records_of_a_document_are_dealt_out_once(spark):
    """metrics were dealt out four times, and sorted where files were read as well."""
    rows = [(d, i, k, v, "b") for d in range(6) for i, (k, v) in enumerate([("Total Recovery", "1"), ("pH", "7"), ("pH", "8"), ("temp_C", "x"), ("comment", "3")]) if d or k != "pH"]
    rows += [(90, 0, "mass", "4", "measurement_results"), (90, 1, "pH", "5", "b"), (None, 0, "pH", "5", "b"), (None, 1, "yield", "5", "b")]
    m = spark.createDataFrame(rows, "doc_id int, at int, key string, value string, bucket string")
    got = model.feature_records(m.drop("bucket"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want = sorted([(d, "total_recovery", "target", 1.0) for d in range(1, 6)] + [(d, "ph", "feature", 8.0) for d in range(1, 6)])
    assert sorted(tuple(r) for r in got.select("doc_id", "key", "role", "value").collect()) == want
    spare = sorted(tuple(r) for r in model.feature_records(m).select("doc_id", "key", "role", "value").collect())
    assert spare == sorted([*want, (90, "mass", "target", 4.0), (90, "ph", "feature", 5.0)])


def test_states_and_relations_are_not_dealt_out_again(spark):
    """states were dealt out and sorted twice; F24: relations were sorted where files are read, too."""
    h = spark.createDataFrame([(1, ["same step", "Same step", "third", "same step"]), (2, []), (3, None)], "hyp_id int, roadmap array<string>")
    got = graphs.roadmap_states(h)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Sort [" not in plan
    rows = got.orderBy("at").collect()
    assert [r.at for r in rows] == [0, 1, 2, 3] and [r.from_id for r in rows] == [None, *[r.id for r in rows[:-1]]]
    assert len({r.id.lower() for r in rows}) == 4
    parts = spark.createDataFrame([(1, 1, 0, "A", "b", "used_in"), (1, 0, 1, "a", "B", "used_in"), (1, 0, 1, "a", "A", "used_in")], "doc_id int, origin int, at int, source string, target string, type string")
    merged = graphs.merge_relations(parts)
    counted = merged.groupBy("doc_id", "type").count()
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert [(r.source, r.target) for r in merged.collect()] == [("a", "B")]


def test_what_many_cite_is_looked_for_once(spark, monkeypatch):
    """each citation was looked for among its query's hits."""
    hits = spark.createDataFrame([("q", "doc-1", 1, "grinding raises the recovery of metal from tailings")], "query_id string, doc_id string, rank int, text string")
    cited = spark.createDataFrame([(f"h{i}", "q", 0, "doc" if i % 2 else "doc-1", "grinding raises the recovery of metal") for i in range(40)], "hyp_id string, query_id string, at int, cited_id string, snippet string")
    met, plain = [], citations.resolve_doc_ids
    monkeypatch.setattr(citations, "resolve_doc_ids", lambda c, h: met.append(c.count()) or plain(c, h))
    got = hypotheses.clean_sources(cited, hits).select("hyp_id", "doc_id").collect()
    assert met == [2] and len(got) == 40 and {r.doc_id for r in got} == {"doc-1"}
