"""Token alignment, prefix trie and license scans against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithos.llm import alignment, licenses, prefixtrie
from lithos.llm.encoding import tokenizer_path

from .helpers import documents, rows_of

# ---- 11 ----


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}

    def of_a(i):
        return bytes(spelled[c] for c in t.id_to_token(i))

    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def ends(ids, spell):
        return np.cumsum([len(spell(i)) for i in ids]).tolist()

    found, counts = [], Counter()
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        whole = f" {text}".encode()
        if not text or b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            found.append(None)
            continue
        a_ends, b_ends = ends(a, of_a), ends(b, of_b)
        groups = []
        for e in sorted(set(a_ends) & set(b_ends)):
            i, j = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)
            groups.append((a[i : a_ends.index(e) + 1], b[j : b_ends.index(e) + 1]))
        pairs = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(pairs.keys())
        found.append((len(a), len(b), groups, pairs))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = f
        written = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((n_a, n_b, len(groups), sum(pairs.values()), sum(n for p, n in pairs.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in pairs.items()), written))
    return out


ODD = [
    "a  b\n\n c\t d ", " leading and trailing  ", "<|endoftext|> <s> </s> <unk> <0x41> text", "漢字 😀 ▁ mark", "漢字かな交じり文 😀😀 x", "it's don't we'll I'M 12345 3.14", " x　 y  z", "é" * 50, "a" * 3000 + " b", "\x00\x01 \x7f é à́",
    "1" * 400, "x", " ", "\n", "   ",
]


def test_alignment(spark):
    docs = documents(spark, n=30).withColumn("n_a", F.lit("x")).withColumn("slice", F.lit(0))
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, "again"), (None, "again"), (None, None)], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.collect())
    want = Counter((i, *x) for (i, _), x in zip(texts, plain_alignment([t for _, t in texts]), strict=True))
    for size in (alignment.SLICE, 300):  # whole slices; and long texts in parts, each in a slice of its own
        got = alignment.alignments(docs, size=size)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        assert Counter((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in got.collect()) == want
    digests = {r["doc_id"]: r["groups"] for r in alignment.alignments(docs.where("doc_id > 0 AND doc_id < 1000"), digest=True).collect()}
    assert all(len(d) in (0, 64) for d in digests.values()) and digests[2] == ""
    assert alignment.alignments(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab e'.\n\t1é漢 　😀▁", max_size=40), min_size=1, max_size=6))
def test_alignment_pieces(texts):
    """Ids and groups of pieces are those of whole texts."""
    encoder = alignment.pair_encoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    assert encoder.by_piece
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    _, m = alignment.measured(data, offsets, encoder)
    want = plain_alignment(texts)
    assert [(*x, g.decode()) for x, g in zip(zip(m.n_a, m.n_b, m.n_groups, m.n_links, strict=True), m.groups, strict=True)] == [(*w[:4], w[6]) for w in want]
    long = alignment.measured_long(np.frombuffer(texts[0].encode(), np.uint8), encoder, 7)
    assert (long.n_a[0], long.n_groups[0], long.groups[0].decode()) == (want[0][0], want[0][2], want[0][6])


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_gallop(a, b):
    x, y = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    i, j = alignment.common_ends(x, y)
    assert x[i].tolist() == y[j].tolist() == sorted(a & b)
    assert alignment.gallop(x, y).tolist() == np.searchsorted(y, x).tolist()


# ---- 12 ----


def plain_trie(rows, component=None):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for v in own.values():
        v.sort()
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        turns = [x[2:] for x in base[:h]] + [x[2:] for x in own[c][h:]]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
        ids = ",".join(map(str, sorted(ends[k]))).encode()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ids).hexdigest()))
    return Counter(out)


def conversations(spark, seed=3):
    r = random.Random(seed)
    texts = ["", None, "hi", "h", "é😀", "long " * 9]
    rows = []
    for c in [*range(-120, 140, 7), *range(200, 260), 100, 5000]:
        rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(texts)) for t in range(r.choice([1, 2, 3, 7, 8]))]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(6)]  # copies
    rows += [(700, t % 50 if t % 9 else None, "user", texts[t % 3]) for t in range(400)]  # one long, with ties and null turns
    rows += [(701, 1, "user", "again")] * 150 + [(None, 1, "user", "nobody's"), (710, None, None, None)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x")).withColumn("depth", F.lit(1)).repartition(4)


@pytest.mark.parametrize("component", [8, 100, 10**6])
def test_trie(spark, component):
    rows, df = conversations(spark)
    got = Counter(tuple(r) for r in prefixtrie.trie(df, component=component).collect())
    assert got == plain_trie(rows)


def test_trie_small(spark):
    _, df = conversations(spark)
    assert prefixtrie.trie(df.limit(0)).count() == 0
    one = [(3, 1, "user", "x")]  # crc32("3") % 6 turns come from conversation 0, which is absent
    got = Counter(tuple(r) for r in prefixtrie.trie(spark.createDataFrame(one, "conv_id long, turn long, role string, text string")).collect())
    assert got == plain_trie(one)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(0, 10**6), st.sampled_from(["wide", "deep", "mixed"]))
def test_decompose(n, seed, shape):
    """Totals of random forests, in each of which centroids halve what is left."""
    r = np.random.default_rng(seed)
    parent = np.array([-1 if i == 0 or r.random() < 0.03 else {"wide": 0, "deep": i - 1, "mixed": int(r.integers(0, i))}[shape] for i in range(n)])
    depth = np.zeros(n, np.int64)
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    values = r.integers(0, 9, (n, 2))
    want = values.copy()
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
    assert np.array_equal(prefixtrie.decompose(parent, depth, r.integers(1, 5, n), values), want)


# ---- 13 ----


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if ord(c) >= 128 or c.isdigit() or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_scan(text):
    words = plain_words(text)
    places, labels, score = [], set(), 0.0
    for t in licenses.PHRASES:
        want = t.text.split()
        at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += at
        labels |= {t.label} if at else set()
    base = sorted(labels)
    score = 1.0 if base else 0.0
    for t in licenses.NOTICES:
        want = t.text.split()
        votes = defaultdict(list)
        for i in range(len(words) - 2):
            for j in range(len(want) - 2):
                if words[i : i + 3] == want[j : j + 3]:
                    votes[i - j].append((i, j))
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= licenses.GAP:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            hits = [v for d in g for v in votes[d]]
            covered = len({j + k for _, j in hits for k in range(3)})
            span = max(i for i, _ in hits) + 3 - min(i for i, _ in hits)
            if covered >= licenses.COVERED * len(want) and covered >= licenses.FILLED * span:
                labels.add(t.label)
                score = max(score, covered / len(want))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), round(score, 12)


def test_licenses(spark):
    notice = licenses.NOTICES[5].text.split()
    edited = [*notice[:20], "oddly", "enough", *notice[20:40], *notice[43:]]
    texts = [
        "Licensed under CC BY-NC 4.0.", "under the GNU General Public License, version 3; the gnu general public license", "MIT License apache license APACHE  LICENSE mit license", "cc", "cc by", "by cc", None, "", "...",
        " ".join(notice), " ".join(edited).upper(), " ".join(notice[:30]), " ".join(notice * 2), "Mİt license K mit LICENSE", "cc by " * 300, "license " * 500, "x " * 3000 + "released under the mit license " + "y " * 3000, "gnu general public license",
        "licensed under the apache license version 2 0 " * 3,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "mit license"), (0, "mit license"), (None, "cc by"), (None, "mit license x mit license"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    got = Counter((*r[:-1], round(r["score"], 12)) for r in licenses.scan(df).collect())
    assert got == Counter((i, *plain_scan(t)) for i, t in rows)
    assert any("mit-notice" in r[6] for r in got if r[0] == 10)  # words put in and left out
    spans = rows_of(licenses.spans(df.where("doc_id = 16")))
    assert {(s["label"], s["first_word"], s["last_word"]) for s in spans} == {("mit", 3003, 3004), ("mit-release", 3000, 3004)}
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.template_places(spark, [licenses.Template("x", "one", True)])


def test_licenses_stay_in_the_jvm(spark):
    plan = licenses.scan(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- columns of any name; doubles ----


def test_stages_with_clashing_columns(spark):
    """Columns named as the stages name theirs inside come out as they went in."""
    import corpus_pipeline

    names = ["__spans", "__id", "__t", "__m", "__n", "__M_", "t", "id", "key", "goes", "component", "own", "size", "target", "positions", "position", "passes", "__place", "__bucket", "__source", "lang_pred", "score", "a.b", "first", "n", "start", "hash", "text_crc32"]
    docs = documents(spark, 25).select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        for r in rows_of(got):
            own = "none" if r["doc_id"] is None else str(r["doc_id"])
            assert all(r[n] == f"{n}-{own}" for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_neighbours_of_doubles(spark):
    """Scores are those of the vectors as given, beyond what floats hold."""
    from lithos.llm import neighbours

    r = np.random.default_rng(5)
    x = r.standard_normal((300, 8)) * 10.0 ** r.integers(-3, 4, (300, 1)) + 1e-9
    x[7] *= 1e45  # no float holds it
    x[9] = 1e-60
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for q in rows_of(neighbours.search(e, e.filter("vec_id % 20 = 0"), 20)):
        got.setdefault(q["query_id"], {})[q["vec_id"]] = q["score"]
    assert set(got) == set(range(0, 300, 20))
    hits = 0
    for i, found in got.items():
        s = x @ x[i]
        s[i] = -np.inf
        assert all(abs(v - s[j]) <= 1e-12 * max(1.0, abs(s[j])) for j, v in found.items())
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(found))
    assert hits >= 0.9 * 20 * len(got)
    assert any(7 in f for f in got.values())
