"""Containment joins against testing every pair, and the plans of the operators that use them."""

import random

import pytest
from pyspark.sql import functions as F

from lithos.operators import citations, containment, evaluation, retrieval


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    letters = "abcde é漢😀"
    texts = [(g, "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, 12, 40])))) for g in (1, 2, None) for _ in range(60)] + [(1, None), (2, "")]
    patterns = [(g, "".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 4, 5, 6])))) for g in (1, 2, None) for _ in range(60)] + [(1, None), (2, ""), (1, "zzz"), (1, texts[30][1])]
    return texts, patterns, spark.createDataFrame(texts, "g int, t string"), spark.createDataFrame(patterns, "g int, p string")


@pytest.mark.parametrize("automaton", [None, True, False])
def test_containing(tables, automaton):
    texts, patterns, t, p = tables
    want = {(x, y) for _, x in texts for _, y in patterns if x is not None and y is not None and y in x}
    got = [tuple(r) for r in containment.containing(t, "t", p, "p", automaton=automaton).select("t", "p").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_containing_within(tables):
    texts, patterns, t, p = tables
    want = {(g, x, y) for g, x in texts for h, y in patterns if g is not None and g == h and x is not None and y is not None and y in x}
    got = [tuple(r) for r in containment.containing(t, "t", p, "p", ["g"]).select("g", "t", "p").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert containment.containing(t.limit(0), "t", p, "p").count() == 0 and containment.containing(t, "t", p.limit(0), "p").count() == 0 and containment.containing(t, "t", p.limit(0), "p", ["g"]).count() == 0


def test_many_patterns_take_the_grams(tables, monkeypatch):
    texts, patterns, t, p = tables
    monkeypatch.setattr(containment, "PATTERNS", 3)
    got = containment.containing(t, "t", p, "p")
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert got.count() == len({(x, y) for _, x in texts for _, y in patterns if x is not None and y is not None and y in x})


def no_loops(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    return df


def test_operators(spark):
    queries = spark.createDataFrame([(1, "Raise the RECOVERY of ore", "at plant A"), (2, "nothing named", ""), (3, "tailings there", None), (4, None, None)], "query_id int, problem string, constraints string")
    cases = spark.createDataFrame([(0, "d0", ["recovery", "x"]), (1, "d1", ["Plant a"]), (2, "d2", []), (3, "d3", None)], "case_no int, dir string, keywords array<string>")
    got = {(r["query_id"], r["case_no"], r["dir"]) for r in no_loops(retrieval.route_cases(queries, cases, ["tailings"])).collect()}
    assert got == {(1, 0, "d0"), (1, 1, "d1"), (3, 0, "d0"), (3, 1, "d1"), (3, 2, "d2"), (3, 3, "d3")}

    words = spark.createDataFrame([(1, 0, "Flotation"), (1, 1, "pH"), (2, 0, "ore"), (2, 1, "dry")], "query_id int, at int, word string")
    aliases = spark.createDataFrame([("flot", "bubbles"), ("ores and more", "rock"), ("ph", "acidity"), ("ph", "pH")], "term string, alias string")
    got = [tuple(r) for r in no_loops(retrieval.expand_keywords(words, aliases)).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "Flotation"), (1, 2, "bubbles"), (1, 3, "pH"), (1, 4, "acidity"), (2, 1, "ore"), (2, 2, "rock"), (2, 3, "dry")]

    nodes = spark.createDataFrame([(1, "Flotation cell"), (2, "Ore"), (3, "Mill"), (4, "ore mill")], "id int, name string")
    edges = spark.createDataFrame([(1, 2, "eats"), (3, 2, "grinds"), (2, 4, "at")], "source int, target int, type string")
    asked = spark.createDataFrame([(7, "ORE"), (7, "mill"), (8, "cell"), (9, "none")], "query_id int, keyword string")
    got = {(r["query_id"], r["id"], r["other"]) for r in no_loops(retrieval.subgraphs(nodes, edges, asked)).collect()}
    assert got == {(7, 2, 1), (7, 2, 3), (7, 2, 4), (7, 3, 2), (7, 4, 2), (8, 1, 2)}
    assert [r["rank"] for r in retrieval.subgraphs(nodes, edges, asked, 2).filter("query_id = 7").orderBy("rank").collect()] == [1, 2]

    chunks = spark.createDataFrame([(i, i % 2, f"Folder{i % 4}/f.TXT") for i in range(12)] + [(99, 0, None)], "doc_id int, chunk_index int, source string")
    assert [r["doc_id"] for r in no_loops(retrieval.source_scan(chunks, ["FOLDER1", "older3/f"], 5)).collect()] == [1, 3, 5, 7, 9]

    cited = spark.createDataFrame([(1, "q", "a"), (2, "q", "xx-ab-yy"), (3, "q", "b"), (4, "q", "none"), (5, "r", "ab"), (6, "q", "")], "citation_id int, query_id string, cited_id string")
    hits = spark.createDataFrame([("q", "ab", 2), ("q", "abc", 1), ("q", "b", 3), ("r", "zab", 1)], "query_id string, doc_id string, rank int")
    got = {r["citation_id"]: r["resolved"] for r in no_loops(citations.resolve_doc_ids(cited, hits)).collect()}
    assert got == {1: "abc", 2: "ab", 3: "b", 4: None, 5: "zab", 6: "abc"}

    case = spark.createDataFrame([("c1", "document-number-1"), ("c2", "other"), ("c3", None)], "case_id string, doc_id string")
    got = {r["case_id"]: r["hit"] for r in no_loops(evaluation.retrieval_hit(case, spark.createDataFrame([("c1", "x/document-num.txt"), ("c2", "oth")], "case_id string, doc_id string"))).collect()}
    assert got == {"c1": True, "c2": False, "c3": False}
