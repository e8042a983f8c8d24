"""Chunks against a plain version, and whole proposals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lithos.operators import chunking, evaluation, graphs, judging, proposals
from lithos.plans import case_queries


def plain_chunks(text, size, overlap):
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", text or "")).strip(" \t\n\r\f\x0b")
    if not text:
        return []
    if len(text) <= size:
        out = [text]
    else:
        units = re.split(r"\n\s*\n+", text)
        units = units if len(units) > 1 else re.split(r"(?<=[.!?…])\s+(?=[А-ЯA-Z0-9])", text)
        out, now = [], ""
        for u in (x.strip(" \t\n\r\f\x0b") for x in units):
            if not u:
                continue
            if len(u) > size:
                out += [now] if now else []
                now = ""
                for i in range(-(-(len(u) - size) // (size - overlap)) + 1):
                    piece = u[i * (size - overlap) :][:size].strip(" \t\n\r\f\x0b")
                    out += [piece] if piece else []
            elif len(now) + len(u) + (2 if now else 0) <= size:
                now = f"{now}\n\n{u}" if now else u
            else:
                out += [now] if now else []
                now = u
        out += [now.strip(" \t\n\r\f\x0b")] if now.strip(" \t\n\r\f\x0b") else []
    if overlap <= 0:
        return out
    return out[:1] + [f"{before[-overlap:]}\n{c}".strip(" \t\n\r\f\x0b")[: size + overlap] for before, c in zip(out, out[1:])]


@pytest.mark.parametrize("size,overlap", [(60, 15), (40, 0), (25, 24)])
def test_chunks(spark, size, overlap):
    r = random.Random(6)
    part = lambda: "".join(r.choice(["word ", "Да. ", "Next! ", "a", " ", "\n", "\n\n", "\r\n\r\n \n", "…", "9 "]) for _ in range(r.randrange(0, 60)))
    texts = [None, "", " \n ", "x" * 300, *(part() for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {i: [] for i in range(len(texts))}
    for x in chunking.chunks(df, size, overlap).orderBy("doc_id", "chunk_index").collect():
        got[x["doc_id"]].append(x["text"])
    for i, t in enumerate(texts):
        assert got[i] == plain_chunks(t, size, overlap), t


def test_topic_recall(spark):
    topics = [("a", "Применение флотации меди"), ("a", "замена насосов"), ("a", "и"), ("b", "Применение флотации меди")]
    outputs = [("a", "предприменение"), ("a", "НАСОСОВ нет"), ("c", "флотации")]
    got = evaluation.topic_recall(spark.createDataFrame(topics, "case_id string, topic string"), spark.createDataFrame(outputs, "case_id string, text string"), stop=("замена",))
    assert {r["case_id"]: (r["topics"], r["found"], r["recall"]) for r in got.collect()} == {"a": (3, 2, 0.667), "b": (1, 0, 0.0)}


def test_whole_graph(spark):
    rows = [
        (1, "Применить известь и депрессант пирита при pH 9,5-10 во флотации, доизвлечь медь", "Известь подавляет пустую породу.", [("d7", "s")], ["Лабораторная проверка", "Пилот"], None),
        (2, "ничего", "", [], [], '{"nodes": [{"id": "K", "type": "Property", "source_doc_id": "z"}, "  M  x "], "links": [{"from": "m X", "to": "k"}, {"source": "K"}]}'),
        (3, None, None, [], ["один"], "no json"),
    ]
    h = spark.createDataFrame(rows, "hyp_id int, text string, mechanism string, sources array<struct<doc_id:string,snippet:string>>, roadmap array<string>, graph string").withColumn("problem", F.lit(""))
    nodes, links, _ = graphs.whole_graph(h)
    n, k = {}, {}
    for x in nodes.collect():
        n.setdefault(x["hyp_id"], {})[x["id"]] = (x["type"], x["source_doc_id"])
    for x in links.collect():
        k.setdefault(x["hyp_id"], set()).add((x["source"], x["target"], x["type"]))
    assert n[1]["флотация"] == ("Process", "d7") and n[1]["pH 9.5-10"] == ("Parameter", "d7") and n[1]["известь"] == ("Material", "d7") and n[1][graphs.GANGUE] == ("Material", None)
    assert {("pH 9.5-10", "флотация", "MODIFIES"), ("известь", "флотация", "USED_IN"), ("известь", graphs.GANGUE, "SUPPRESSES")} <= k[1]
    assert any(t == "VALIDATES" for _, _, t in k[1])
    assert set(n[2]) == {"K", "M x"} and n[2]["K"] == ("Property", "z") and k[2] == {("m X", "k", "AFFECTS")}
    assert {"целевой KPI", "процесс обогащения"} <= set(n[3])


def test_constraints(spark):
    rows = [(1, "Новое оборудование", "без капитальных вложений; TRL 4"), (2, "без капитальных вложений, на заводе", "Без капвложений, TRL4"), (3, "pH 5-6, pH 12", "pH 7-9"), (4, None, None), (5, "новая установка", "")]
    h = spark.createDataFrame(rows, "hyp_id int, text string, said string").withColumns({"mechanism": F.lit(None).cast("string"), "reasoning": F.lit("")})
    got = {(x["hyp_id"], x["kind"], x["low"]) for x in judging.constraint_issues(h, F.col("said")).collect()}
    assert got == {(1, "capex", None), (2, "trl", None), (3, "range", 5.0), (3, "value", 12.0)}
    assert {x["hyp_id"]: x["n_constraint_issues"] for x in judging.with_constraint_issues(h, F.col("said")).collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0}


def test_generate(spark):
    """Runs of the smallest tables: some hypotheses are approved and some are not, each for its reasons."""
    got = case_queries.h19(spark, "/root/testdata/sf0.001").collect()
    assert {x["approved"] for x in got} == {True, False} and {x["source_grounded"] for x in got} == {True, False}
    for x in got:
        assert not x["approved"] or (x["source_grounded"] and x["n_constraint_issues"] == 0 and x["mandatory_passed"] == 7)
    runs = {}
    for x in got:
        runs.setdefault(x["run_id"], []).append(x)
    for rows in runs.values():
        rows.sort(key=lambda x: x["rank"])
        assert [x["rank"] for x in rows] == list(range(1, len(rows) + 1))
        assert [(x["approved"], x["objective"]) for x in rows] == sorted(((x["approved"], x["objective"]) for x in rows), reverse=True)
    none = spark.createDataFrame([], "query_id string, rank int, doc_id long, chunk_index int, text string, score double")
    assert proposals.context(none).count() == 0
