"""The pipeline's stages, each on its own input, and without the folder."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from lithos.llm.common import scratch

from .helpers import documents, rows_of, words


def test_stages(spark):
    docs = documents(spark, 60)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, name)
        stage(spark, docs, "").write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = (rows_of(before), rows_of(docs))
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"]

    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} >= {2, 5, 8, 17} and all(r["lang"] for r in after)
    before, after = seen["near_duplicates"]
    texts = Counter(r["text"] for r in after)
    assert set(texts.values()) == {1} and {r["text"] for r in after} <= {r["text"] for r in before}
    before, after = seen["substring_dedup"]
    assert len(before) == len(after) and all(r["n_chars"] == len(r["text"]) for r in after)
    runs = Counter()
    old = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        w = words(r["text"])
        if r["text"] == old[r["doc_id"]]:
            runs.update({tuple(w[i : i + 20]) for i in range(len(w) - 19)})
    assert max(runs.values(), default=1) == 1
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and max(Counter(r["doc_id"] for r in after).values()) <= 3
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    sums = Counter()
    for r in after:
        sums[r["sequence_id"]] += r["length"]
    assert max(sums.values()) <= 4096


def test_near_duplicates_of_odd_rows(spark):
    """One row of each group, whatever its id: repeated rows, null ids, several texts of one id."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "x")
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, text), (5, text), (5, near), (None, text), (None, near), (9, other), (9, other), (None, other), (2, ""), (2, ""), (3, None), (None, None), (7, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, component long")
    got = rows_of(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, ""))
    assert list(got[0]) == docs.columns
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in got)
    first = [t for i, t in kept if i == 5]
    assert len(first) == 1 and first[0] in (text, near)
    assert sorted(x for x in kept if x[0] != 5) == sorted([(9, other), (2, ""), (2, ""), (3, ""), (-1, ""), (7, "alone here")])


def test_empty(spark):
    docs = documents(spark, 10).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_rest_without_the_folder(tmp_path):
    """The entry imports, and lists the other queries, where the folder and the pipeline are gone."""
    root = Path(corpus_pipeline.__file__).parent
    for p in root.iterdir():
        if p.name not in ("corpus_pipeline.py", "lithos", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "lithos").mkdir()
    for p in (root / "lithos").iterdir():
        if p.name != "llm":
            (tmp_path / "lithos" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [k for k in q if k.startswith('op')] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
