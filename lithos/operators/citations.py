"""Overlap of citations with their sources, and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from . import windows
from .containment import containing
from .lineage import kept, settled, spread
from .retrieval import ranked


def token_overlap(snippet: Column, corpus: Column) -> Column:
    """Share of the snippet's tokens that the corpus holds."""
    own = tx.overlap_tokens(snippet)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, tx.overlap_tokens(corpus))) / F.size(own))


def substring_overlap(snippet: Column, corpus: Column, window: int = 24) -> Column:
    """1 if the snippet's normal form, or a run of `window` words of it, is in the corpus's; else the best
    token overlap of such runs; snippets of under 4 words have their token overlap."""
    return tx.let(prepared(snippet, window), lambda p: _met(p, corpus, lambda _, sub: sub))


def prepared(snippet: Column, window: int = 24) -> Column:
    """What overlap_with() needs of a snippet: to be computed once where many corpora meet it."""

    def parts(form: Column) -> Column:
        words = F.split(form, " ")
        n = F.least(F.size(words), F.lit(window))
        runs = tx.let(F.struct(words.alias("w"), n.alias("n")), lambda s: F.transform(F.sequence(F.lit(0), F.size(s["w"]) - s["n"]), lambda i: F.array_join(F.slice(s["w"], i + 1, s["n"]), " ")))
        with_tokens = F.transform(runs, lambda r: tx.let(tx.overlap_tokens(r), lambda t: F.struct(r.alias("run"), t.alias("tokens"), F.size(t).alias("n"))))
        counted = lambda t: F.struct(t.alias("tokens"), F.size(t).alias("n"), tx.overlap_tokens(form).alias("form_tokens"), form.alias("form"), F.size(words).alias("n_words"), with_tokens.alias("runs"))
        return tx.let(tx.overlap_tokens(snippet), counted)

    return tx.let(tx.overlap_form(snippet), parts)


def _met(p: Column, corpus: Column, result) -> Column:
    """result(token overlap, substring overlap) of a prepared snippet. The corpus is put into its form once, and its
    tokens are held against the snippet's once; the runs are then held against what both have."""
    both = F.array_intersect(F.array_union(p["tokens"], p["form_tokens"]), tx.overlap_tokens(corpus))

    def scores(c: Column) -> Column:
        share = lambda t, n: F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(t, c["both"])) / n)
        own, whole = share(p["tokens"], p["n"]), c["whole"]
        best = F.array_max(F.transform(p["runs"], lambda r: F.when(whole.contains(r["run"]), F.lit(1.0)).otherwise(share(r["tokens"], r["n"]))))
        best = F.coalesce(best, F.when(F.size(p["runs"]) == 0, F.lit(0.0)))
        sub = F.when((p["form"] == "") | (whole == ""), F.lit(0.0)).when(whole.contains(p["form"]), F.lit(1.0)).when(p["n_words"] < 4, own).otherwise(best)
        return result(own, sub)

    return tx.let(F.struct(tx.overlap_form(corpus).alias("whole"), both.alias("both")), scores)


def overlap_with(p: Column, corpus: Column) -> Column:
    """C03 for a prepared snippet."""
    return _met(p, corpus, F.greatest)


def fitted(p: Column, terms: Column, corpus: Column) -> Column:
    """What of a prepared snippet, and of terms in lower case, can count in a window of corpus: tokens, runs and terms that the whole
    corpus lacks are in none of its windows. Sizes stay those of the snippet, so that overlap_with() is the same for each window; and
    snippets that differ only in what the corpus lacks become equal."""

    def parts(c: Column) -> Column:
        # the small form of a capital sigma depends on what stands around it
        can = lambda t: c["sigma"] | c["low"].contains(t) | c["plain"].contains(t)
        said = lambda f: F.when(c["sigma"] | (f == "") | c["whole"].contains(f), f)
        some = lambda tokens: F.sort_array(F.filter(tokens, can))
        runs = F.array_distinct(F.transform(p["runs"], lambda r: F.struct(said(r["run"]).alias("run"), some(r["tokens"]).alias("tokens"), r["n"].alias("n"))))
        return F.struct(
            some(p["tokens"]).alias("tokens"), p["n"].alias("n"), some(p["form_tokens"]).alias("form_tokens"), said(p["form"]).alias("form"), F.least(p["n_words"], F.lit(4)).alias("n_words"),
            F.filter(runs, lambda r: r["run"].isNotNull() | (F.size(r["tokens"]) > 0)).alias("runs"), some(terms).alias("terms"),
        )

    low = tx.let(F.lower(corpus), lambda x: F.struct(x.alias("low"), F.translate(x, "ё", "е").alias("plain"), tx.overlap_form(corpus).alias("whole"), corpus.contains("Σ").alias("sigma")))
    return tx.let(low, parts)


def _live(f: Column) -> Column:
    """Whether what is fitted() to a corpus can score in some window of it."""
    return (F.size(f["tokens"]) > 0) | (F.size(f["form_tokens"]) > 0) | (F.size(f["terms"]) > 0) | F.exists(f["runs"], lambda r: r["n"] == 0)


def _may_overlap(p: Column, text: Column) -> Column:
    """Whether overlap_with() can be over 0: some token of the snippet stands in the text, in its spelling or with е for ё; or a run
    without tokens might. Costs a fraction of it."""
    held = lambda low, plain: F.exists(F.array_union(p["tokens"], p["form_tokens"]), lambda t: low.contains(t) | plain.contains(t))
    return F.exists(p["runs"], lambda r: r["n"] == 0) | tx.let(F.lower(text), lambda low: held(low, F.translate(low, "ё", "е")))


def citation_overlap(snippet: Column, corpus: Column) -> Column:
    """C03."""
    return tx.let(prepared(snippet), lambda p: overlap_with(p, corpus))


def resolve_doc_ids(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit's doc_id that a citation's cited_id names: exactly, or else the best-ranked one that contains it
    or that it contains. citations: citation_id, query_id, cited_id; resolved is null where there is none."""
    ids = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    exact = citations.join(ids.select("query_id", F.col("doc_id").alias("cited_id"), F.lit(True).alias("exact")), ["query_id", "cited_id"], "left")
    rest = exact.filter("exact IS NULL")
    pairs = containing(ids, "doc_id", rest, "cited_id", ["query_id"]).unionByName(containing(rest, "cited_id", ids, "doc_id", ["query_id"])).distinct()
    loose = rest.join(pairs, ["query_id", "cited_id"]).join(ids, ["query_id", "doc_id"])
    best = loose.groupBy("citation_id").agg(F.min_by("doc_id", F.struct("rank", "doc_id")).alias("near"))
    return exact.join(best, "citation_id", "left").withColumn("resolved", F.when(F.col("exact"), F.col("cited_id")).otherwise(F.col("near"))).drop("exact", "near")


def garbage_id(doc_id: Column) -> Column:
    """Whether what stands as an id of a document is none: blank, unknown, a piece of the answer's own structure, or with brackets."""
    low = F.lower(doc_id)
    return F.coalesce((doc_id == "") | (doc_id == "unknown") | tx.contains_any(low, ["verification", "roadmap", "reasoning", "'"]) | doc_id.rlike(r"[\[\]{}]"), F.lit(True))


def grounding(citations: DataFrame, corpus: DataFrame, least: float = lx.OVERLAP_MIN, shortest: int = 20) -> DataFrame:
    """C11: per hypothesis, whether a citation (hyp_id, doc_id, snippet) holds against its document's corpus, and the counts of what fails."""
    joined = citations.join(corpus.select("doc_id", "corpus"), "doc_id", "left")
    overlap = F.when(F.col("corpus").isNotNull() & (F.length(tx.strip(F.coalesce("snippet", F.lit("")))) >= shortest), citation_overlap(F.col("snippet"), F.col("corpus")))
    state = F.when(F.col("corpus").isNull(), "unknown").when(F.col("overlap").isNull(), "short").when(F.col("overlap") >= least, "grounded").otherwise("weak")
    by = joined.withColumn("overlap", overlap).withColumn("state", state).groupBy("hyp_id")
    return by.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("grounded", "unknown", "short", "weak")]).withColumn("source_grounded", F.col("grounded") > 0)


def hypothesis_terms(text: Column, most: int = 12) -> Column:
    """The domain patterns that a text matches, in order, then its distinct words of 6 letters or more."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.filter(F.array(*[F.when(tx.matches(low, p), F.lit(p)) for p in lx.DOMAIN_TERMS]), lambda x: x.isNotNull())
    words = F.array_except(tx.all_of(low, tx.SMALL + "{6,}"), F.array(*[F.lit(w) for w in lx.TERM_STOP]))
    return F.slice(F.array_distinct(F.concat(named, words)), 1, most)


def sentence_bounds(corpus: Column, start: Column, length: Column, max_len: int, left: int = 80, right: int = 60) -> Column:
    """corpus[start : start + length] from the sentence's beginning, at most `left` characters before, to its end, at
    most `right` behind; at most max_len characters of whole words; white space as one space."""
    before_at = F.greatest(F.lit(0), start - left)
    before, behind = F.substring(corpus, before_at + 1, start - before_at), F.substring(corpus, start + length + 1, F.lit(right))
    back = F.reverse(before)
    lefts = [F.when(F.instr(back, s[::-1]) > 0, start - F.instr(back, s[::-1]) + 1) for s in lx.SENTENCE_STARTS]
    rights = [F.when(F.instr(behind, s) > 0, start + length + F.instr(behind, s) - 1 + len(s.strip())) for s in lx.SENTENCE_ENDS]
    a, b = F.coalesce(*lefts, start), F.coalesce(*rights, F.least(F.length(corpus), start + length))

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, max_len)
        return F.when(F.length(t) > max_len, F.when(F.instr(head, " ") > 0, tx.strip(F.regexp_replace(head, r"(?s) [^ ]*$", ""))).otherwise(head)).otherwise(t)

    out = tx.let(tx.strip(F.substring(corpus, a + 1, b - a)), cut)
    return F.coalesce(F.nullif(F.regexp_replace(out, r"\s+", " "), F.lit("")), F.substring(corpus, start + 1, length))


#: Windows are looked for in blocks of so many characters, so that a long text is not walked from its beginning for each.
_BLOCK = 4000


def _best(corpus: Column, step: int, lengths: tuple[int, ...], shortest: Column, score, live: Column) -> Column:
    """(score, turn, start, length) of the window with the highest score(window); the first length and start of equals. Without
    `live` no window scores, and the first is looked at alone."""
    widest = max(lengths)
    last = F.when(live, F.greatest(F.lit(0), F.length(corpus) - shortest)).otherwise(F.lit(0))

    def in_block(at: Column) -> Column:
        block = F.substring(corpus, at + 1, F.lit(_BLOCK + widest))
        starts = F.sequence(F.lit(0), F.least(F.lit(_BLOCK - step), last - at), F.lit(step))

        def scored(text: Column, n: int, turn: int) -> Column:
            own = lambda s: score(F.substring(text, s + 1, F.lit(n)))
            return F.transform(starts, lambda s: F.struct(own(s).alias("score"), F.lit(-turn).alias("turn"), (-(at + s)).alias("start"), F.lit(n).alias("length")))

        return tx.let(block, lambda t: F.array_max(F.concat(*[F.when(F.lit(n) >= shortest, scored(t, n, i)).otherwise(F.array().cast("array<struct<score:double,turn:int,start:int,length:int>>")) for i, n in enumerate(lengths)])))

    blocks = F.sequence(F.lit(0), last - last % F.lit(_BLOCK), F.lit(_BLOCK))
    return tx.let(F.array_max(F.transform(blocks, in_block)), lambda b: F.struct(b["score"].alias("score"), (-b["start"]).alias("start"), b["length"].alias("length")))


def best_windows(pairs: DataFrame, max_len: int = 280, step: int = 20) -> DataFrame:
    """The window of the corpus with the highest overlap with the snippet, and 0.06 for each of its terms; the first of
    equals. pairs: pair_id, snippet, corpus, and terms ARRAY<STRING> where terms count. excerpt is the window, between sentence ends (C07);
    where no window scores, the keywords' window (C06) or the snippet itself.

    `step` divides the blocks that long texts are walked in.
    """
    terms = F.col("terms") if "terms" in pairs.columns else F.array().cast("array<string>")
    found = _windowed(pairs, F.col("snippet"), terms, max_len, step, "__w")
    return found.select("pair_id", "__w.start", "__w.length", "__w.score", "__w.excerpt")


def _windowed(pairs: DataFrame, wanted: Column, terms: Column, max_len: int, step: int, name: str) -> DataFrame:
    """pairs with the struct `name`: (start, length, score, excerpt) of the window of corpus that is best for `wanted`, and the
    excerpt's overlap with corpus. Of pairs with one corpus whose words differ only in what that lacks, one is looked at."""
    lengths = (max_len, max_len + 50, max_len - 30)
    none = F.array().cast("array<string>")
    own = pairs.withColumns({"__s": wanted, "__t": F.transform(F.coalesce(terms, none), F.lower)})
    own = own.withColumn("__f", F.when(F.col("__s").isNotNull(), fitted(prepared(F.col("__s")), F.col("__t"), F.col("corpus"))))
    own = kept(own.withColumn("__k", F.when(F.col("__f").isNotNull(), F.sha2(F.concat(F.sha2("corpus", 256), F.to_json("__f")), 256))), "windows")
    asked = spread(own.filter("__k IS NOT NULL").select("__k", "__f", "corpus"), "__k").dropDuplicates(["__k"])
    bonus = lambda w: 0.06 * tx.let(F.lower(w), lambda low: F.size(F.filter("__f.terms", lambda t: low.contains(t))))
    shortest = F.least(F.lit(100), F.length("corpus"))
    score = lambda w: F.when(_may_overlap(F.col("__f"), w), overlap_with(F.col("__f"), w)).otherwise(F.lit(0.0)) + bonus(w)
    asked = asked.withColumn("__b", _best(F.col("corpus"), step, lengths, shortest, score, _live(F.col("__f"))))
    # the window without white space at its end keeps its start
    taken = F.length(tx.strip(F.substring("corpus", F.col("__b.start") + 1, F.col("__b.length"))))
    asked = asked.withColumn("__e", F.when(F.col("__b.score") > 0, sentence_bounds(F.col("corpus"), F.col("__b.start"), taken, max_len)))
    best = asked.select("__k", "__b", "__e", citation_overlap(F.col("__e"), F.col("corpus")).alias("__o"))
    found = spread(own.join(best, "__k", "left"), "pair_id")
    found = found.withColumn("__x", F.coalesce("__e", keyword_window(F.col("__s"), F.col("corpus"), F.col("__t"), max_len)))
    overlap = F.when(F.col("__e").isNotNull(), F.col("__o")).otherwise(citation_overlap(F.col("__x"), F.col("corpus")))
    return found.withColumn(name, F.struct("__b.start", "__b.length", "__b.score", F.col("__x").alias("excerpt"), overlap.alias("overlap"))).drop("__s", "__t", "__f", "__k", "__b", "__e", "__o", "__x")


def keyword_window(snippet: Column, corpus: Column, terms: Column, max_len: int = 280, step: int = 40) -> Column:
    """The window with the most of the snippet's words of 5 letters or more and of the terms; the first of equals; the
    snippet's beginning where none is met."""
    words = F.filter(tx.all_of(F.lower(snippet), tx.SMALL + "{5,}"), lambda w: ~w.isin(*lx.KEYWORD_STOP))
    count = lambda keys, w: tx.let(F.lower(w), lambda low: F.size(F.filter(keys, lambda k: low.contains(k))).cast("double"))
    some = tx.let(F.lower(corpus), lambda low: F.filter(F.concat(words, terms), lambda k: low.contains(k) | corpus.contains("Σ")))  # others are in no window
    best = tx.let(some, lambda keys: _best(corpus, step, (max_len + 80,), F.least(F.lit(81), F.length(corpus)), lambda w: count(keys, w), F.size(keys) > 0))
    met = tx.let(best, lambda b: F.when(b["score"] > 0, F.regexp_replace(tx.strip(F.substring(corpus, b["start"] + 1, F.lit(max_len))), r"\s+", " ")))
    return F.coalesce(met, F.substring(snippet, 1, max_len))


#: So many runs of snippets at most go to every task.
RUNS = 100_000


def candidates(snippets: DataFrame, docs: DataFrame, size: int = 3, least: int = 1) -> DataFrame:
    """Pairs of snippets (item_id, snippet) and docs (doc_id, corpus) that share at least `least` runs of `size` words (all of a snippet
    with fewer words), wherever they stand in either: an equi-join on hashes of the runs, counted before texts
    are met. copy numbers the different texts of one doc_id, which may be null."""
    words = lambda df, text: df.withColumn("w", tx.all_of(F.lower(text), r"[\p{L}\p{M}\p{N}_]+"))

    def runs(df: DataFrame, *key: str) -> DataFrame:
        hashed = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.xxhash64(F.slice("w", i, F.col("n"))))
        return df.filter((F.col("n") > 0) & (F.size("w") >= F.col("n"))).select(*key, "n", F.explode(F.array_distinct(hashed)).alias("run"))

    docs = docs.withColumn("__row", F.xxhash64("doc_id", "corpus"))  # ids may be null or repeated
    asked = settled(runs(words(snippets, "snippet").withColumn("n", F.least(F.lit(size), F.size("w"))), "item_id"))
    held = runs(words(docs, "corpus").join(F.broadcast(asked.select("n").distinct()), F.lit(True)), "doc_id", "__row")  # 1 to size
    met = F.broadcast(asked) if asked.count() <= RUNS else asked  # few snippets: the documents' runs are not dealt out
    shared = held.join(met, ["n", "run"]).groupBy("item_id", "doc_id", "__row").agg(F.count("*").alias("shared"))
    needed = asked.groupBy("item_id").agg(F.least(F.lit(least), F.count("*")).alias("needed"))
    found = shared.join(needed, "item_id").filter("shared >= needed").select("item_id", "doc_id", "__row")
    placed = ranked(found, ["item_id", "doc_id"], [F.asc("__row")], None, "copy").drop("doc_id")
    return placed.join(snippets, "item_id").join(docs, "__row").select("item_id", "doc_id", "copy", "snippet", "corpus")


def align(pairs: DataFrame, max_len: int = 280) -> DataFrame:
    """The excerpt that stands for a snippet, and its overlap. pairs: pair_id, snippet, corpus, and hypothesis where its
    terms and wording count: the best window for the snippet; for the hypothesis, where it overlaps better by 0.05; the
    snippet itself where that overlaps better than both and by 0.25 at least. Blank snippets and corpora overlap by 0. raw: the snippet's
    overlap with its corpus, where it is known."""
    none, hinted = F.array().cast("array<string>"), "hypothesis" in pairs.columns
    hint = F.col("hypothesis").cast("string") if hinted else F.lit(None).cast("string")
    own = pairs.select(
        "pair_id", F.col("snippet").cast("string").alias("snippet"), F.col("corpus").cast("string").alias("corpus"), hint.alias("hypothesis"), (hypothesis_terms(hint) if hinted else none).alias("terms"),
        (F.col("raw") if "raw" in pairs.columns else F.lit(None)).cast("double").alias("raw"), F.lit("raw" in pairs.columns).alias("raw_known"),
    )
    own = kept(own.withColumn("__regular", windows.regular(F.col("snippet")) & windows.regular(F.col("corpus")) & windows.regular(hint)), "pairs")
    out = windows.align(spread(own.filter("__regular"), "pair_id"), max_len)
    if own.filter("NOT __regular").isEmpty():
        return out
    return out.unionByName(_align_each(own.filter("NOT __regular").select(*[c for c in ("pair_id", "snippet", "corpus", "hypothesis", "raw") if c in pairs.columns]), max_len))


def _align_each(pairs: DataFrame, max_len: int) -> DataFrame:
    """align() for texts whose parts may have other small forms than the whole: each window is put into its form."""
    none = F.array().cast("array<string>")
    exact = tx.overlap_form(F.col("corpus")).contains(tx.overlap_form(F.col("snippet")))
    hinted = "hypothesis" in pairs.columns
    own = spread(pairs, "pair_id").withColumn("exact", exact)
    own = own.withColumn("terms", F.when(~F.col("exact"), hypothesis_terms(F.col("hypothesis"))).otherwise(none) if hinted else none)
    out = _windowed(own, F.col("snippet"), F.col("terms"), max_len, 20, "__w").withColumns({"excerpt": F.col("__w.excerpt"), "overlap": F.col("__w.overlap")}).drop("__w")
    if hinted:
        wanted = F.when(~F.col("exact") & (F.coalesce("hypothesis", F.lit("")) != ""), F.col("hypothesis"))
        out = _windowed(out, wanted, F.col("terms"), max_len, 20, "__h").withColumns({"hint": F.when(wanted.isNotNull(), F.col("__h.excerpt")), "hint_overlap": F.when(wanted.isNotNull(), F.col("__h.overlap"))})
        better = F.coalesce(F.col("hint_overlap") > F.col("overlap") + 0.05, F.lit(False))
        out = out.withColumns({"excerpt": F.when(better, F.col("hint")).otherwise(F.col("excerpt")), "overlap": F.when(better, F.col("hint_overlap")).otherwise(F.col("overlap"))})
    if "raw" not in pairs.columns:
        out = out.withColumn("raw", citation_overlap(F.col("snippet"), F.col("corpus")))
    blank = (tx.strip(F.coalesce("snippet", F.lit(""))) == "") | (F.coalesce("corpus", F.lit("")) == "")
    keep = blank | ~F.col("exact") & (F.col("overlap") < F.col("raw")) & (F.col("raw") >= 0.25)
    overlap = F.when(blank, F.lit(0.0)).when(F.col("exact"), F.lit(1.0)).when(keep, F.col("raw")).otherwise(F.col("overlap"))
    return out.select("pair_id", F.when(keep, F.substring("snippet", 1, max_len)).otherwise(F.col("excerpt")).alias("aligned"), overlap.alias("overlap"))
