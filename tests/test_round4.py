"""What the findings of the fourth round named."""

import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import citations, proposals, windows
from lithos.plans import state_queries


def test_windows_are_not_put_into_their_forms_one_by_one(spark, monkeypatch):
    """c08_align: each window of each pair was put into its form, which took hours for some thousand pairs."""
    r = random.Random(5)
    base = ["ab", "abc", "abcd", "cde", "ёлка", "елка", "ель", "Ab", "漢", "漢字", "カナ", "a_b", "é", "12", "abcabc", "recovery", "флотация", "日本語"]
    text = lambda n: "".join(r.choice(base) + (r.choice(["  ", "-", " — ", ". ", ",", "\n", "", "(", "; "]) if r.random() < 0.4 else " ") for _ in range(n))
    rows = []
    for i in range(24):
        corpus = "abc" * 150 + text(40) if i == 5 else text([1, 2, 20, 90, 200, 500][i % 6])
        a = r.randrange(max(1, len(corpus) - 40))
        snippet = [corpus[a : a + 60], corpus[a : a + 200] + " " + text(6), text(30), "zzzzzz qqqqqq"][i % 4]
        rows.append((i, snippet, corpus, [None, "флотация recovery grinding", text(8)][i % 3]))
    df = spark.createDataFrame(rows, "pair_id int, snippet string, corpus string, hypothesis string")
    want = sorted(map(tuple, citations._align_each(df, 100).collect()))
    monkeypatch.setattr(citations, "_best", lambda *_: pytest.fail("a window was put into its form"))
    monkeypatch.setattr(windows, "STARTS", 7)  # long texts are scored in parts
    assert sorted(map(tuple, citations.align(df, 100).collect())) == want and len(want) == 24


def test_texts_whose_parts_have_other_small_forms_are_aligned_as_well(spark):
    text = "ΟΔΟΣ grinding raises recovery. İstanbul tailings are kept. " * 4
    rows = [(1, "grinding raises the recovery", text), (2, "grinding raises recovery", text.replace("Σ", "s").replace("İ", "I"))]
    df = spark.createDataFrame(rows, "pair_id int, snippet string, corpus string")
    assert [x[0] for x in df.select(windows.regular(F.col("corpus"))).collect()] == [False, True]
    got = {x["pair_id"]: x["overlap"] for x in citations.align(df).collect()}
    assert got == {1: 1.0, 2: 1.0}


def test_reviews_of_a_run_are_not_sent_through_the_driver(spark):
    """h19_stored_runs: a count a run became a number for each sample behind the last exchange, so that Spark took them for few and broadcast them."""
    counts = spark.createDataFrame([("a", 25_000), ("b", 3), ("c", 0), ("d", 20_000)], "run_id string, k long")
    got = state_queries.numbers(counts.groupBy("run_id").agg(F.sum("k").alias("k")))
    found = {x["run_id"]: (x["n"], x["low"], x["high"]) for x in got.groupBy("run_id").agg(F.count_distinct("i").alias("n"), F.min("i").alias("low"), F.max("i").alias("high")).collect()}
    assert found == {"a": (25_000, 0, 24_999), "b": (3, 0, 2), "d": (20_000, 0, 19_999)} and got.count() == 45_003
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_wide_wordings_are_not_broadcast(spark, monkeypatch):
    """h19_stored_runs: up to 100 000 wordings went through the driver, however long they were."""
    rows = [(i, "q", f"raise pH to {i}", "m" * 50, "r", "p", 5.0) for i in range(40)]
    h = spark.createDataFrame(rows, "hyp_id int, query_id string, text string, mechanism string, reasoning string, problem string, novelty double")
    none = F.array().cast("array<struct<doc_id:string,snippet:string>>")
    h = h.withColumns({"sources": none, "roadmap": F.array(F.lit("a"), F.lit("b")), **{c: F.lit(5.0) for c in ("feasibility", "expected_value", "risk_technical", "risk_economic")}})
    hits = spark.createDataFrame([], "query_id string, text string")
    gaps = spark.createDataFrame([], "query_id string, severity string")
    met, plain = [], F.broadcast
    monkeypatch.setattr(proposals.F, "broadcast", lambda df: met.append(1) or plain(df))
    few = sorted(map(str, proposals.enriched(h, hits, gaps, F.lit(False)).collect()))
    assert met == [1] and len(few) == 40
    monkeypatch.setattr(proposals, "WORDING_BYTES", 1_000)
    assert sorted(map(str, proposals.enriched(h, hits, gaps, F.lit(False)).collect())) == few and met == [1]
