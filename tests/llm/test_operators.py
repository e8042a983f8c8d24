"""Each operator against a plain version of itself, with awkward rows and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.llm import fingerprints, jaccard, language, mixing, neighbours, packing, sharding, substrings, tokenfiles, warc
from lithos.llm.common import bucket_of, rank_distinct, scratch
from lithos.llm.encoding import tokenizer_path

from .helpers import documents, rows_of, words


def empty(spark):
    return documents(spark).limit(0)


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(tokenizer_path())
    return [*ids_of.t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- common ----


def test_bucket_of(spark):
    bounds = [-5, 0, 3, 9, 9 + 1, 50, 700]
    got = spark.range(-20, 800).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(x <= r["id"] for x in bounds) for r in got)


def test_rank_distinct(spark):
    values = [None, "b", "a", "ä", "Z", "\U0001F600", "￿"]
    got = {r["s"]: r["__rank"] for r in rank_distinct(spark.createDataFrame([(v,) for v in values], "s string").repartition(3), "s").collect()}
    assert got == {v: i for i, v in enumerate([*sorted(v for v in values if v is not None), None])}


# ---- 1 ----


def test_warc(spark):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (9, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é<html>" * 5000), (None, "u", "alone"), (7, "u", "a\r\n\r\nb"), (-3, "u", "neg")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r["page_id"]: r for r in rows_of(warc.read_archives(warc.write_archives(warc.mark_revisits(pages), scratch(spark, "t"))))}
    assert len(got) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.base32_sha1(data))
        if r["record_type"] == "response":
            assert r["payload"] == data and r["refers_to"] is None
    assert {p: got[p]["refers_to"] for p in got if got[p]["record_type"] == "revisit"} == {1: 9, 2: 9, 3: 4}
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages.limit(0)), scratch(spark, "t"))).count() == 0
    twice = pages.filter("page_id IN (1, 9)").union(pages.filter("page_id = 9"))  # each row has a record
    again = rows_of(warc.read_archives(warc.write_archives(warc.mark_revisits(twice), scratch(spark, "t"))))
    assert sorted((r["page_id"], r["record_type"]) for r in again) == [(1, "revisit"), (9, "response"), (9, "response")]
    least = rows_of(warc.mark_revisits(pages, least=1))
    assert {r["page_id"] for r in least if r["refers_to"] is not None} == {1, 2}


def test_warc_damage():
    import io

    good = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x-page:1>")], b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")
    assert len(list(warc.records(io.BytesIO(good * 3)))) == 3
    for cut in range(1, len(good)):
        with pytest.raises(warc.DamagedArchive):
            list(warc.records(io.BytesIO(good + good[:cut])))
    with pytest.raises((warc.DamagedArchive, zlib.error)):
        list(warc.records(io.BytesIO(good[:40] + bytes([good[40] ^ 255]) + good[41:])))
    wrong = zlib.compressobj(6, zlib.DEFLATED, 31)
    body = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"
    with pytest.raises(warc.DamagedArchive):
        list(warc.records(io.BytesIO(wrong.compress(body) + wrong.flush())))


# ---- 2 ----


@pytest.mark.parametrize("part,sample", [(60, 20_000), (12, 40)])
def test_neighbours(spark, monkeypatch, part, sample):
    """One tree of cells, and cells with trees of their own, over several parts and blocks."""
    monkeypatch.setattr(neighbours, "PART", part)
    monkeypatch.setattr(neighbours, "SAMPLE", sample)
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    r = np.random.default_rng(1)
    centres = r.standard_normal((8, 16))
    x = (centres[r.integers(0, 8, 500)] + 0.4 * r.standard_normal((500, 16))) * r.uniform(0.5, 2, (500, 1))
    x[100:250] = x[100]  # a third are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(7, x[7].astype(np.float32).tolist()), (7, (-x[7]).astype(np.float32).tolist()), (40, x[40].astype(np.float32).tolist())]  # repeated ids
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [float("inf")] * 16), (None, [1.0] * 16), (1101, [0.01, 0.02])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = defaultdict(list)
    for q in rows_of(neighbours.search(e, e.filter("vec_id % 20 = 0"), 20)):
        got[q["query_id"]].append((q["rank"], q["vec_id"], q["score"]))
    assert set(got) == {i for i in range(0, 500, 20)}
    v = x.astype(np.float32).astype(np.float64)
    hits = 0
    for i, found in got.items():
        s = v @ v[i]
        s[i] = -np.inf
        s[7] = abs(s[7]) if i != 7 else s[7]  # of repeated rows the best
        want = np.lexsort((np.arange(500), -np.round(s, 12)))[:20]
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21))
        assert all(abs(score - s[j]) < 1e-9 for _, j, score in found if j < 500)
        hits += len(set(want) & {j for _, j, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    few = e.filter("vec_id < 4")
    assert Counter(r["query_id"] for r in rows_of(neighbours.search(few, few, 20))) == {0: 3, 1: 3, 2: 3, 3: 3}
    assert neighbours.search(e.limit(0), e, 3).count() == 0
    assert neighbours.search(e, e.limit(0), 3).count() == 0
    assert abs(neighbours.chi2_quantile(0.95, 8) - 15.507) < 1e-2


def test_neighbours_query(spark, monkeypatch):
    """The query itself against brute force, over several cells: at least 0.9 of each table's neighbours."""
    monkeypatch.setattr(neighbours, "PART", 300)
    monkeypatch.setattr(neighbours, "SAMPLE", 100)
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toPandas()
        v, ids = np.stack(e["embedding"].to_numpy()).astype(np.float64), e["vec_id"].to_numpy()
        got = defaultdict(dict)
        for r in rows_of(neighbours.op2_srs_neighbours(spark, d)):
            got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
        hits, place = 0, {x: i for i, x in enumerate(ids)}
        assert set(got) == {x for x in ids if x % 20 == 0}
        for q, found in got.items():
            s = v @ v[place[q]]
            assert sorted(found) == list(range(1, 21)) and all(abs(s[place[x]] - score) < 1e-9 for x, score in found.values())
            s[place[q]] = -np.inf
            hits += len({x for x, _ in found.values()} & set(ids[np.lexsort((ids, -s))[:20]]))
        assert hits >= 0.9 * 20 * len(got)


# ---- 3 ----


def test_mix(spark):
    docs = documents(spark).withColumn("size", mixing.word_count(F.col("text"))).withColumn("target", F.lit("clash"))
    got = rows_of(mixing.mix(docs))
    assert len(got) == docs.count()
    total = sum(len(words(r["text"])) for r in got)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        assert len(r["positions"]) * r["size"] == r["taken"] and all(0 <= p <= 1 for p in r["positions"])
        by[r["source"]].append(r)
    names = [*sorted(s for s in by if s is not None), None]
    sizes = {s: sum(r["size"] for r in by[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    want, free = {}, set(names)
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * sizes[s]
            free.discard(s)
    want |= {s: level * weight[s] for s in free}
    for s in names:
        assert abs(by[s][0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in by[s]) - want[s]) <= max(r["size"] for r in by[s])
    grid = np.linspace(0, 1, 100001)
    spans = defaultdict(list)  # a source's demand, numerically integrated, against the words that come up to each position
    for s in names:
        knots = mixing.SCHEDULES[weight[s] - 1]
        rate = np.interp(grid, [t for t, _ in knots], [v for _, v in knots])
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        for p, n in sorted((p, r["size"]) for r in by[s] for p in r["positions"]):
            spans[s].append((p, n))
        done = 0
        for p, n in spans[s]:  # positions are the middles of spans that follow one another
            assert abs(np.interp(p, grid, area) / area[-1] * want[s] - (done + n / 2)) < 0.01 * want[s] + 1
            done += n
    again = {(r["doc_id"], r["text"]): r["taken"] for r in rows_of(mixing.mix(docs.repartition(5)))}
    assert again == {(r["doc_id"], r["text"]): r["taken"] for r in got}
    order = rows_of(mixing.training_order(mixing.mix(docs)))
    assert len(order) == sum(len(r["positions"]) for r in got) and [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert mixing.mix(docs.limit(0)).count() == 0
    twice = docs.union(docs.filter("doc_id IN (1, 4) OR doc_id IS NULL"))  # repeated rows have places of their own
    assert len(rows_of(mixing.mix(twice))) == docs.count() + docs.filter("doc_id IN (1, 4) OR doc_id IS NULL").count()
    nothing = docs.withColumn("size", F.lit(0).cast("long"))
    assert {(r["target"], r["taken"]) for r in rows_of(mixing.mix(nothing))} == {(0.0, 0)}


def test_schedule(spark):
    s = ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))
    got = spark.range(0, 101).select((F.col("id") / 100).alias("q"), mixing.at_demand(F.col("id") / 100, s).alias("t")).collect()
    grid = np.linspace(0, 1, 200001)
    area = np.concatenate([[0], np.cumsum((np.interp(grid[1:], [0, 0.5, 1], [0.5, 0.75, 2]) + np.interp(grid[:-1], [0, 0.5, 1], [0.5, 0.75, 2])) / 2)])
    for r in got:
        assert abs(r["t"] - np.interp(r["q"] * area[-1], area, grid)) < 1e-4


# ---- 4 ----


def plain_removal(rows):
    """rows: (doc_id, text, hash of the text)."""
    seen, out = set(), {}
    for doc_id, text, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, x[2])):
        w = words(text)
        gone = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone |= set(range(i, i + 20))
            seen.add(k)
        left = [x for i, x in enumerate(w) if i not in gone]
        out[doc_id, text] = (len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest(), " ".join(left))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_substrings(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substrings, "BUCKET", 1)
        monkeypatch.setattr(substrings, "SORTED", 5)
    docs = documents(spark, 90).withColumn("start", F.lit(3)).withColumn("n", F.lit(4))
    docs = docs.union(docs.filter("doc_id = 4"))
    long = " ".join(f"u{i % 37}" for i in range(300))  # several texts under one id, and under none, that share passages
    odd = [(i, t, "en", "s", 1, 3, 4) for i in (2, 500, None) for t in (long, "x y " + long[90:700], long[:400] + " z", None, "short", long)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    want = plain_removal([(r["doc_id"], r["text"], r["t"]) for r in rows_of(docs.withColumn("t", F.xxhash64("text")))])
    got = rows_of(substrings.kept_words(docs))
    assert len(got) == docs.count() and sum(r["n_removed"] for r in got) > 100
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter((r["doc_id"], *want[r["doc_id"], r["text"]][:3]) for r in rows_of(docs))
    left = Counter((i, " ".join(words(x[3]))) for (i, _), x in want.items())
    assert set(left) == {(r["doc_id"], " ".join(words(r["text"]))) for r in rows_of(substrings.without_repeats(docs))}
    assert substrings.kept_words(docs.limit(0)).count() == 0


def test_equal_windows():
    r = np.random.default_rng(3)
    w = r.integers(0, 2, 400)
    got = substrings.equal_windows(w)
    runs = [tuple(w[i : i + 20]) for i in range(381)]
    assert len(set(zip(runs, got))) == len(set(runs)) == len(set(got))


# ---- 5 and 7 ----


def test_packing(spark):
    docs = documents(spark).withColumn("length", F.lit(1)).union(documents(spark).withColumn("length", F.lit(1)).filter("doc_id = 4"))
    long = spark.createDataFrame([(1000, "many words of text here. " * 3000, "en", "s", 1, 1)], docs.schema)
    docs = docs.union(long)
    want = Counter()
    for r in rows_of(docs):
        want[(r["doc_id"], tuple(ids_of(r["text"])))] += 1
    got = rows_of(packing.pack_documents(docs))
    by_sequence, pieces = defaultdict(list), Counter()
    for p in got:
        by_sequence[p["sequence_id"]].append(p)
        pieces[(p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"])] += 1
    expected = Counter()
    for (doc, ids), n in want.items():
        for a in range(0, len(ids), 4096):
            expected[(doc, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096]), len(ids))] += n
    assert pieces == expected
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_token_queries(spark, tmp_path):
    """op5 and op7 against the tokenizer on whole texts; the padding of op5 on a table of many documents."""
    docs = documents(spark, 40).union(documents(spark, 3, seed=9).withColumn("text", F.repeat(F.lit("long text of words; "), 2500)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = rows_of(docs)
    pieces = rows_of(packing.op5_pack_windows(spark, str(tmp_path)))
    by = Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0)
    assert by == Counter((r["doc_id"], len(ids_of(r["text"]))) for r in rows)
    wanted = Counter()
    for r in rows:
        ids = ids_of(r["text"])
        for p in {(p["start"], p["length"]) for p in pieces if (p["doc_id"], p["doc_tokens"]) == (r["doc_id"], len(ids))}:
            wanted[(r["doc_id"], *p, crc(ids[p[0] : p[0] + p[1]]))] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == wanted
    got = rows_of(tokenfiles.op7_token_files(spark, str(tmp_path)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], len(i), crc(i)) for r in rows for i in [ids_of(r["text"])])
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    many = rows_of(packing.op5_pack_windows(spark, "/root/testdata/sf0.01"))
    assert sum(p["length"] for p in many) >= 0.95 * 4096 * len({p["sequence_id"] for p in many})


def test_windows():
    r = random.Random(2)
    for n in (1, 2, 3, 50, 700):
        sizes = [r.randint(1, 4096) if n < 100 else min(4096, int(r.lognormvariate(6, 1)) + 1) for _ in range(n)]
        parts = packing.windows(sizes)
        assert sorted(i for p in parts for i in p) == list(range(n))
        assert max(sum(sizes[i] for i in p) for p in parts) <= 4096
        if n == 700:
            assert len(parts) <= 1.05 * sum(sizes) / 4096 + 1
    assert packing.windows([]) == []
    halves = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in halves) == [14, 16]


def test_token_files(spark):
    docs = documents(spark).withColumn("n_tokens", F.lit(1)).repartition(2)
    manifest = tokenfiles.write_tokens(docs, scratch(spark, "t"), length=64)
    got = rows_of(tokenfiles.read_documents(manifest))
    order = sorted(rows_of(docs), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start, want = 0, set()
    for r in order:
        ids = ids_of(r["text"])
        want.add((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(order)
    first = min(rows_of(manifest), key=lambda r: r["shard"])
    reader = tokenfiles.open_tokens(first["tokens_path"])
    flat = []
    for i in range(-(-first["n_tokens"] // 64)):
        ids, mask = tokenfiles.sequence(reader, i)
        assert len(ids) == len(mask) == 64
        flat += ids[mask].tolist()
    assert flat[: len(ids_of(order[0]["text"]))] == ids_of(order[0]["text"]) and len(flat) == first["n_tokens"]
    assert tokenfiles.read_documents(tokenfiles.write_tokens(empty(spark), scratch(spark, "t"))).count() == 0


# ---- 6 ----


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    model = language.train(docs.filter(~held))
    got = rows_of(language.predict(docs.filter(held), model))
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    odd = documents(spark).withColumn("score", F.lit("clash"))
    out = {r["doc_id"]: r for r in rows_of(language.predict(odd, model))}
    assert len(out) == odd.count() and all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (2, 5, 8, 17))
    nothing = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in rows_of(language.predict(odd, nothing))} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0
    check = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in check)


def test_language_counts(spark):
    """The model's counts are those of a direct count of n-grams."""
    texts = [("Ab é a", "x"), ("ab", "x"), (None, "x"), ("zz", "y"), ("q", None)]
    langs, prior, logp = language.train(spark.createDataFrame(texts, "text string, lang string"))
    assert langs == ["x", "y"] and np.allclose(np.exp(prior), [2 / 3, 1 / 3])
    assert np.allclose(np.exp(logp).sum(axis=1), 1)
    of, feature = language._features(["ab", "é"])
    assert np.bincount(of).tolist() == [2 + 3 + 2, 1 + 2 + 1] and feature.max() < language.FEATURES


def plain_features(word):
    """Hashed n-grams of a word between spaces, one by one."""
    w, out, mask = f" {word.lower()} ", [], (1 << 64) - 1
    for n in language.ORDERS:
        for i in range(len(w) - n + 1):
            g = w[i : i + n]
            if (n == 1 and g == " ") or " " in g[1:-1] or (i == len(w) - 1):
                continue
            code = n
            for ch in g:
                code = (code * 0x110001 + ord(ch)) & mask
            code ^= code >> 30
            code = code * 0xBF58476D1CE4E5B9 & mask
            code ^= code >> 27
            code = code * 0x94D049BB133111EB & mask
            out.append((code ^ code >> 31) >> (64 - language.FEATURE_BITS))
    return out


def test_language_query(spark, tmp_path):
    """The query against plain naive Bayes."""
    docs = documents(spark, 40).withColumn("score", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = rows_of(docs)
    held = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    counts, priors = defaultdict(Counter), Counter()
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and not held(r):
            priors[r["lang"]] += 1
            for w in words(r["text"]):
                counts[r["lang"]].update(plain_features(w))
    langs = sorted(priors)
    got = rows_of(language.op6_language_nb(spark, str(tmp_path)))
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["lang_pred"], round(r["score"], 6), r["held_out"]) for r in got}
    for r in rows:
        if not any(ch.isalpha() for ch in r["text"] or ""):
            want = ("und", 0.0)
        else:
            f = [x for w in words(r["text"]) for x in plain_features(w)]
            total = {k: sum(counts[k].values()) + language.SMOOTHING * language.FEATURES for k in langs}
            logs = [np.log(priors[k] / sum(priors.values())) + sum(np.log((counts[k][x] + language.SMOOTHING) / total[k]) for x in f) for k in langs]
            best = int(np.argmax(logs))
            scaled = (np.array(logs) - logs[best]) * min(1, language.EVIDENCE / max(len(f), 1))
            want = (langs[best], round(1 / np.exp(scaled).sum(), 6))
        assert (r["doc_id"], *want, held(r)) in by, r


def test_language_without_labels(spark):
    docs = documents(spark, 20).withColumn("lang_pred", F.lit("own"))
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = rows_of(language.keep_known(bare))
    assert len(kept) == bare.count() - 4 and all(r["lang"] is None and r["lang_pred"] == "own" for r in kept)
    assert language.keep_known(docs).columns == docs.columns and {r["lang_pred"] for r in rows_of(language.keep_known(docs))} == {"own"}


# ---- 8 ----


def test_fingerprints(spark):
    docs = documents(spark).withColumn("fingerprint", F.lit(1))
    got = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprints(docs))}
    order = sorted(rows_of(docs), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0), reverse=True)
    prints = {}
    for r, after in zip(order, order[1:] + order[:1]):
        text, following, g = r["text"] or "", after["text"] or "", got[r["doc_id"]]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(g["fingerprint"], text) == text and prints.setdefault(g["edited_fingerprint"], edited) == edited
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        if text == edited:
            assert g["near_edited"] == 1.0
        elif len(text) > 300:
            assert 0.6 <= g["near_edited"] < 1
    assert len(got) == len(order)
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    one = rows_of(fingerprints.fingerprints(docs.filter("doc_id = 4")))[0]
    assert one["near_next"] == 1.0


def test_prefix_hash():
    r = random.Random(4)
    a = "".join(r.choice("ab") for _ in range(300))
    b = a[:120] + "x" + a[121:]
    p, q = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
    assert p.extension(0, q, 0) == 120 and p.extension(121, q, 121) == 179
    for _ in range(300):
        i, j, n = r.randrange(280), r.randrange(280), r.randrange(1, 20)
        assert p.equal(i, q, j, n) == (a[i : i + n] == b[j : j + n])
    f = fingerprints.Fingerprint.of(fingerprints.terms(a))
    assert str(fingerprints.Fingerprint.parse(str(f))) == str(f)
    assert 0.9 < f.likeness(fingerprints.Fingerprint.of(fingerprints.terms(b))) < 1


def test_likeness_of_shifted_texts():
    of = lambda text: fingerprints.Fingerprint.of(fingerprints.terms(text))
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    for size in (120, 800, 3000):
        text = " ".join(r.choice(vocabulary) for _ in range(size))
        middle = len(text) // 2
        other = of(" ".join(r.choice(vocabulary[::-1]) for _ in range(size)))
        for near in ("new " + text, text[5:], text[:middle] + " new " + text[middle:], text[:middle] + text[middle + 7 :], "a b " + text[:middle] + "x" + text[middle:]):
            assert 0.8 < of(text).likeness(of(near)) < 1 and of(near).likeness(of(text)) == of(text).likeness(of(near))
        assert of(text).likeness(other) < 0.2
        assert of(text).likeness(of(text[: 2 * middle // 3])) > 0.2  # a third, whose places are denser
    for period in ("a ", "one and the same line\n"):
        text = period * 400
        assert of(text).likeness(of("new " + text)) > 0.8 and of(text).likeness(of(text[:3001] + "new" + text[3001:])) > 0.6
    short, f = of("abc"), of("new " + text)
    assert short.likeness(of("abd")) == 0 and of("").likeness(short) == 0 and of("").likeness(of("")) == 1
    assert len(f.places) <= fingerprints.PLACES and fingerprints.Fingerprint.parse(str(f)).likeness(f) == 1


def plain_places(text):
    """(order, place) of a text's places, hashed window by window, and the bound under which they were taken."""
    p, b, w = fingerprints.PRIMES[0], fingerprints.BASES[0], fingerprints.WINDOW
    orders = []
    for i in range(len(text) - w + 1):
        h = sum((ord(ch) + 1) * pow(b, j, p) for j, ch in enumerate(text[i : i + w])) % p
        orders.append(int(fingerprints.mix64(np.array([h + 1], np.uint64))[0]) >> 33)
    bound = sorted(orders)[fingerprints.PLACES - 1] if len(orders) >= fingerprints.PLACES else fingerprints.ORDERS
    return [(o, i + w) for i, o in enumerate(orders[:-1]) if o < bound] + [(0, len(text))], bound


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (x, m), (y, n) = plain_places(a), plain_places(b)

    def spans(text, places, bound):
        ends = [at for o, at in places if o < bound or at == len(text)]
        return Counter((text[s:e], text[max(0, e - fingerprints.WINDOW) : e] if len(text) >= fingerprints.WINDOW else "") for s, e in zip([0, *ends], ends))

    both = spans(a, x, min(m, n)) & spans(b, y, min(m, n))
    return sum(len(s) * k for (s, _), k in both.items()) / max(len(a), len(b), 1)


def test_fingerprint_query(spark, tmp_path):
    """The query against spans that are compared as strings; several null and equal ids."""
    docs = documents(spark, 24).filter("doc_id <> 11 OR doc_id IS NULL")
    more = [(None, "another text without an id, of some words more than the first", "en", "s", 1), (4, "a second text of id four", "en", "s", 1)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(fingerprints.op8_prefix_fingerprints(spark, str(tmp_path)))
    order = sorted(rows_of(docs), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] is not None, r["text"] or ""))
    assert len(got) == len(order)
    want = Counter()
    for r, after in zip(order, order[1:] + order[:1]):
        text, following = r["text"] or "", after["text"] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        want[(r["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest(), round(plain_likeness(text, edited), 9), round(plain_likeness(text, following), 9))] += 1
    assert Counter((g["doc_id"], g["n_chars"], g["edited_sha256"], round(g["near_edited"], 9), round(g["near_next"], 9)) for g in got) == want


# ---- 9 ----


def shingle_sets(rows):
    out = []
    for doc_id, text in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
        out.append((doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    return out


@pytest.mark.parametrize("cell,replicas", [(1024, 3), (4, 100), (6, 0)])
def test_jaccard(spark, monkeypatch, cell, replicas):
    """Whole regions, divided ones, those that are always divided into cells, and always into blocks."""
    monkeypatch.setattr(jaccard, "REGION", 2)
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "REPLICAS", replicas)
    monkeypatch.setattr(jaccard, "LEAST_PIVOTS", min(16, cell))
    base = rows_of(documents(spark, 90))
    r = random.Random(8)
    rows = [(x["doc_id"], x["text"]) for x in base]
    seedtext = [f"v{i}" for i in range(120)]
    for k in range(60):  # chains of near copies, at all distances from their origin
        for i in r.sample(range(len(seedtext)), 1):
            seedtext[i] = f"n{k}"
        rows.append((2000 + k, " ".join(seedtext)))
        rows.append((3000 + k, " ".join(f"v{i}" if i != k else "Z" for i in range(120))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)).repartition(3)
    s = shingle_sets(rows)
    parent = list(range(len(s)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i][1] and 100 * len(s[i][1] & s[j][1]) >= 80 * len(s[i][1] | s[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(s):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    got = {x["doc_id"]: x for x in rows_of(jaccard.jaccard_components(docs))}
    assert len(got) == len(rows)
    for i, (d, x) in enumerate(s):
        assert (got[d]["n_shingles"], got[d]["component_id"]) == (len(x), least.get(find(i))), d
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


# ---- 10 ----


def test_sharding(spark):
    docs = documents(spark).withColumn("slot", F.lit("clash"))
    for n in (1, 7, 40):
        got = rows_of(sharding.shard(docs.select("doc_id", "text", "slot"), F.xxhash64("text"), F.col("doc_id"), n))
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        counts = [len(by[s]) for s in range(n)]
        assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1 and set(by) <= set(range(n))
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in rows_of(sharding.shard(same, F.xxhash64("text"), F.col("doc_id"), n))} for n in (40, 41))
    assert max(Counter(a.values()).values()) == 75
    assert sum(a[i] != b[i] for i in a) < 0.1 * len(a)
    groups = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 4000).cast("string").alias("text"))
    torn = defaultdict(set)
    for r in rows_of(sharding.shard(groups, F.xxhash64("text"), F.col("doc_id"), 40)):
        torn[r["text"]].add(r["shard"])
    assert sum(len(s) > 1 for s in torn.values()) <= 80  # a shard's end tears a group, where it cuts a slot
    assert sharding.shard(docs.limit(0), F.xxhash64("text"), F.col("doc_id"), 40).count() == 0


def test_sharding_query(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(sharding.op10_shard_ring(spark, str(tmp_path)))
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in rows_of(docs))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got) and max(r["slot"] for r in got) < max(counts.values())
