"""From raw model output to hypothesis rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from .lineage import settled, spread
from .ranks import ranked_wide
from .retrieval import ranked

RAW = "text string, mechanism string, reasoning string, novelty_score double, feasibility_score double, expected_value_score double, risk struct<technical:double,economic:double>, roadmap array<string>, sources array<struct<doc_id:string,snippet:string>>"
# The control step; the defaults in sanitized() are fixed values as well.
_CONTROL = "Сравнение с контрольным режимом и оценка влияния на целевой KPI"


def parse_json(raw: Column, schema: str) -> Column:
    """The object in a model's output, code fences and surrounding prose taken off and raw control characters allowed; null if there is none."""
    bare = _bare(raw)
    return F.coalesce(F.when(_is_object(bare), F.from_json(bare, schema, _OPTIONS)), F.from_json(_inside(bare), schema, _OPTIONS))


_OPTIONS = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}


def _bare(raw: Column) -> Column:
    return tx.strip(F.regexp_replace(F.regexp_replace(tx.strip(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def _is_object(text: Column) -> Column:
    return text.startswith("{") & F.get_json_object(F.regexp_replace(text, r"[\x00-\x1f]", " "), "$").isNotNull()


def _inside(bare: Column) -> Column:
    """The object inside of other words; null if there is none."""
    object_ = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(_is_object(object_), object_)


def items(samples: DataFrame, schema: str = RAW) -> DataFrame:
    """(run_id, sample_no, at, item) of samples (run_id, sample_no, raw): a list under "hypotheses", one object there, or the object itself."""
    dealt = spread(samples.select("run_id", "sample_no", "raw"), "run_id", "sample_no")
    # the object is looked for and parsed once, with the list and with its own fields
    parsed = dealt.withColumn("__bare", _bare(F.col("raw"))).withColumn("__json", F.coalesce(F.when(_is_object(F.col("__bare")), F.col("__bare")), _inside(F.col("__bare"))))
    fields = [c.name for c in StructType.fromDDL(schema)]
    parsed = parsed.withColumn("__got", F.from_json("__json", f"hypotheses array<struct<{_colons(schema)}>>, {schema}", _OPTIONS))
    single = F.struct(*[F.col(f"__got.{c}").alias(c) for c in fields])
    own = F.when(F.col("__got.hypotheses").isNotNull(), F.col("__got.hypotheses")).when(F.col("__got.text").isNotNull(), F.array(single))
    return parsed.select("run_id", "sample_no", F.posexplode(own).alias("at", "item"))


def _colons(schema: str) -> str:
    depth, out, start = 0, [], 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip().replace(" ", ":", 1))
            start = i + 1
    return ",".join(out)


def entities(raw: Column) -> Column:
    """The entities (name, type, properties) of a model's output; those without a name go, the default type is Parameter."""
    found = F.coalesce(parse_json(raw, lx.ENTITY_SCHEMA)["entities"], F.array().cast("array<struct<name:string,type:string,properties:map<string,string>>>"))
    typed = lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], F.lit("Parameter")).alias("type"), F.coalesce(e["properties"], F.create_map().cast("map<string,string>")).alias("properties"))
    return F.transform(F.filter(found, lambda e: F.coalesce(e["name"], F.lit("")) != ""), typed)


def undefaulted(df: DataFrame) -> DataFrame:
    """A novelty of 5 (or none) becomes 6; risks of 5 and 5, or none, become 4 and 4."""
    both = (F.coalesce("risk_technical", F.lit(5.0)) == 5) & (F.coalesce("risk_economic", F.lit(5.0)) == 5)
    risk = lambda c: F.when(both, 4.0).otherwise(F.coalesce(c, F.lit(5.0)))
    return df.withColumns({"novelty": F.when(F.coalesce("novelty", F.lit(5.0)) == 5, 6.0).otherwise(F.col("novelty")), "risk_technical": risk("risk_technical"), "risk_economic": risk("risk_economic")})


def roadmap(steps: Column) -> Column:
    """Steps without empty ones; a single step gets a control step; none is null."""
    clean = F.filter(F.transform(steps, tx.strip), lambda s: s != "")
    return F.when(F.size(clean) >= 2, clean).when(F.size(clean) == 1, F.array_append(clean, F.lit(_CONTROL)))


def roadmap_from_text(text: Column) -> Column:
    return roadmap(F.split(text, r"[\n;]+"))


def sanitized(df: DataFrame) -> DataFrame:
    """Rows of text of 15 characters or more, with defaults for what is missing; strict tells which need none."""
    enough = lambda c, n: F.length(tx.strip(F.coalesce(c, F.lit("")))) >= n
    df = df.filter(enough("text", 15))
    fixed = roadmap(F.col("roadmap"))
    strict = enough("text", 20) & enough("mechanism", 10) & fixed.isNotNull() & (F.size("sources") > 0)
    mechanism = F.when(enough("mechanism", 10), F.col("mechanism")).otherwise(F.lit("Предполагаемое влияние параметров процесса на целевой показатель"))
    reasoning = F.when(enough("reasoning", 1), F.col("reasoning")).otherwise(F.coalesce(F.try_element_at("sources", F.lit(1))["snippet"], F.lit("Требуется обоснование экспертом")))
    default = F.array(F.concat(F.lit("Лабораторная проверка на пробах 1 кг с реагентами: "), F.substring("text", 1, 70)), F.lit(_CONTROL))
    return df.withColumns({"strict": strict, "roadmap": F.coalesce(fixed, default), "reasoning": reasoning, "mechanism": mechanism})


def merge_samples(found: DataFrame) -> DataFrame:
    """Of hypotheses (run_id, sample_no, at, text) of a run with the same dedupe key, the first."""
    k = found.withColumn("__k", tx.dedupe_key(F.col("text")))
    return ranked(k, ["run_id", "__k"], [F.asc("sample_no"), F.asc("at")], 1, "__n").drop("__n", "__k")


def numbered(merged: DataFrame) -> DataFrame:
    """hyp_id, the run's first 8 characters and the hypothesis's number."""
    n = ranked_wide(merged, ["run_id"], [F.asc("sample_no"), F.asc("at")], "hyp_no").withColumnRenamed("hyp_no", "__n")
    return n.withColumn("hyp_id", F.concat(F.substring("run_id", 1, 8), F.lit("-h"), (F.col("__n") - 1).cast("string"))).drop("__n")


def repaired(hyps: DataFrame, repairs: DataFrame, columns: tuple[str, ...] = ("text", "mechanism", "reasoning")) -> DataFrame:
    """Hypotheses that are not approved take what repairs (hyp_id and columns) has for them; ids stay."""
    r = repairs.select("hyp_id", *[F.col(c).alias(f"__{c}") for c in columns])
    j = hyps.join(r, "hyp_id", "left")
    new = {c: F.when(~F.col("approved"), F.coalesce(f"__{c}", c)).otherwise(F.col(c)) for c in columns}
    return j.withColumns(new).select(*hyps.columns)


def clean_sources(cited: DataFrame, hits: DataFrame, least: float = lx.OVERLAP_MIN, shortest: int = 20) -> DataFrame:
    """A hypothesis's citations (hyp_id, query_id, at, cited_id, snippet, and hypothesis, its text, where hints count) with ids of its
    hits, one for each document, snippets of at most 300 characters, filled from the hit's text; the top hit where
    none is left. A snippet that overlaps its document by less than `least` gives way to the excerpt that alignment (C08)
    finds, where that overlaps better and has `shortest` characters."""
    from .citations import align, citation_overlap, garbage_id, resolve_doc_ids

    hinted = "hypothesis" in cited.columns
    # what is cited is looked for once for each query, however many cite it
    named = cited.filter(~garbage_id(F.col("cited_id")))
    each = settled(resolve_doc_ids(named.select("query_id", "cited_id").distinct().withColumn("citation_id", F.struct("query_id", "cited_id")), hits).filter("resolved IS NOT NULL").select("query_id", "cited_id", "resolved"))
    ids = named.join(each, ["query_id", "cited_id"])
    text = settled(hits.groupBy("query_id", "doc_id").agg(F.min_by("text", "rank").alias("doc_text"), F.min("rank").alias("rank")))
    corpus = text.select("query_id", F.col("doc_id").alias("resolved"), F.col("doc_text").alias("corpus"))
    good = ids.join(corpus.select("query_id", "resolved", F.substring("corpus", 1, 200).alias("__head")), ["query_id", "resolved"])
    snippet = F.substring(F.when(F.coalesce("snippet", F.lit("")) != "", F.col("snippet")).otherwise(F.col("__head")), 1, 300)
    once = ranked(good.withColumn("snippet", snippet).select("hyp_id", "query_id", "resolved", "at", "snippet"), ["hyp_id", "resolved"], [F.asc("at")], 1, "__n").drop("__n", "at")
    if hinted:
        once = once.join(cited.groupBy("hyp_id").agg(F.coalesce(F.first("hypothesis"), F.lit("")).alias("hypothesis")), "hyp_id", "left")
    once = settled(once)
    # many citations are alike: each different one is held against its document once, and aligned once
    key = ["query_id", "resolved", "snippet"]
    held = settled(spread(once.select(*key).distinct(), *key).join(corpus, ["query_id", "resolved"]).withColumn("before", citation_overlap(F.col("snippet"), F.col("corpus"))).drop("corpus"))
    found = once.join(held, key, "left")
    wide = [*key, "hypothesis"] if hinted else key
    weak = found.filter(F.col("before") < least).select(*wide, "before").distinct().join(corpus, ["query_id", "resolved"])
    weak = weak.select(F.struct(*wide).alias("pair_id"), "snippet", "corpus", F.col("before").alias("raw"), *(["hypothesis"] if hinted else []))
    better = found.join(align(weak).select("pair_id.*", "aligned", "overlap"), wide, "left")
    use = (F.col("overlap") > F.col("before")) & (F.length("aligned") >= shortest)
    out = settled(better.select("hyp_id", F.col("resolved").alias("doc_id"), F.when(use, F.col("aligned")).otherwise(F.col("snippet")).alias("snippet")))
    top = text.groupBy("query_id").agg(F.min_by(F.struct("doc_id", "doc_text"), "rank").alias("t"))
    bare = cited.select("hyp_id", "query_id").distinct().join(out.select("hyp_id").distinct(), "hyp_id", "left_anti").join(top, "query_id")
    return out.union(bare.select("hyp_id", "t.doc_id", F.substring("t.doc_text", 1, 200)))
