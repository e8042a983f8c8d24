"""Evaluation of runs against gold topics and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from .containment import containing
from .retrieval import ranked


def numbered_line(line: Column) -> Column:
    """(number, topic) of a line "1. …", "2) …", "## Пункт N: …" or with a bar cell "1. …"; null for others."""

    def parse(x: Column) -> Column:
        forms = (r"(?U)^(\d+)[.)]\s*(.+)$", r"(?iU)^##\s*(?:Гипотеза|Пункт)\s+(\d+):\s*(.+)$")
        cell = F.get(F.filter(F.transform(F.split(x, r"\|"), tx.strip), lambda c: c.rlike(r"^\d+\.\s*.+$")), 0)
        got = lambda g: F.coalesce(*[F.nullif(F.regexp_extract(x, p, g), F.lit("")) for p in forms], F.when(x.contains("|"), F.regexp_extract(cell, r"^(\d+)\.\s*(.+)$", g)))
        topic = F.nullif(tx.strip(got(2)), F.lit(""))
        return F.when(topic.isNotNull(), F.struct(got(1).alias("number"), topic.alias("topic")))

    return tx.let(tx.strip(line), parse)


def numbered_topics(docs: DataFrame) -> DataFrame:
    """(doc_id, at, number, topic) of the numbered lines (numbered_line())."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "line")).withColumn("n", numbered_line(F.col("line")))
    return lines.filter("n IS NOT NULL").select("doc_id", "at", "n.number", "n.topic")


def enriched_structure(text: Column, name: Column, stop: Sequence[str] = lx.STRUCTURE_STOP, most: int = 12) -> Column:
    """A text with two numbered lines or more, of a brainstorm, or from a file of hypotheses: its numbered lines as headings,
    and a header with its first keywords before them; other texts as they are."""
    storm, hyps = F.lower(text).contains("мозгового штурма"), F.lower(name).contains("гипотез")

    def rewrite(parsed: Column) -> Column:
        topics = F.filter(parsed, lambda p: p["n"].isNotNull())
        words = F.flatten(F.transform(topics, lambda p: tx.all_of(F.lower(p["n"]["topic"]), tx.SMALL + "{5,}")))
        keys = F.slice(F.array_except(words, F.array(*[F.lit(w) for w in stop])), 1, most)
        prefix = F.when(hyps | storm, "Гипотеза").otherwise("Пункт")
        lines = F.transform(parsed, lambda p: F.when(p["n"].isNotNull(), F.concat(F.lit("## "), prefix, F.lit(" "), p["n"]["number"], F.lit(": "), p["n"]["topic"])).otherwise(p["line"]))
        head = F.array(
            F.concat(F.lit("# "), F.when(hyps, "Материалы предприятия").otherwise("Структурированный документ"), F.lit(": "), name),
            F.when(storm | hyps, "Нумерованные направления — приоритет для RAG."), F.when(F.size(keys) > 0, F.concat(F.lit("Ключевые темы: "), F.array_join(keys, ", "))), F.lit(""),
        )
        return F.when(storm | hyps | (F.size(topics) >= 2), F.array_join(F.concat(F.filter(head, lambda x: x.isNotNull()), lines), "\n")).otherwise(text)

    lines = F.split(F.regexp_replace(text, r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r")
    return tx.let(F.transform(lines, lambda x: F.struct(x.alias("line"), numbered_line(x).alias("n"))), rewrite)


def distinct_topics(topics: DataFrame) -> DataFrame:
    """A document's topic once whatever its case, the first."""
    return ranked(topics.withColumn("__k", F.lower("topic")), ["doc_id", "__k"], [F.asc("at")], 1, "__n").drop("__n", "__k")


def topic_labels(docs: DataFrame, stop: Sequence[str] = lx.TOPIC_STOP, most: int = 6) -> DataFrame:
    """A document's commonest words of 6 letters or more, longer and then earlier ones first among equals."""
    words = docs.select("doc_id", F.posexplode(tx.all_of(F.lower("text"), tx.SMALL + "{6,}")).alias("at", "word")).filter(~F.col("word").isin(list(stop)))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return ranked(counted, ["doc_id"], [F.desc("n"), F.desc(F.length("word")), F.asc("at")], most).select("doc_id", "rank", "word", "n")


def topic_recall(topics: DataFrame, outputs: DataFrame, stop: Sequence[str] = lx.TOPIC_STOP, shortest: int = 4) -> DataFrame:
    """Per case the topics, those found and the recall. topics: case_id, topic; outputs: case_id, text (any number of rows).

    A topic is found if a third of its distinct words, one at least, stand in one of the case's texts; a topic
    without words counts as a topic that is neither found nor missed. A case's texts are cut into their
    distinct words, which meet the topics' words of the case: no text is joined to a topic.
    """
    words = F.array_except(F.array_distinct(tx.all_of(F.lower("topic"), f"[а-яёa-z]{{{shortest},}}")), F.array(*[F.lit(w) for w in stop]).cast("array<string>"))
    t = topics.select("case_id", F.monotonically_increasing_id().alias("topic_no"), words.alias("words"))
    asked = t.select("case_id", "topic_no", F.explode_outer("words").alias("word"))
    # a run of letters of a topic stands in a text only within one of the text's runs of such letters
    runs = outputs.select("case_id", F.explode(F.array_distinct(tx.all_of(F.lower("text"), f"[а-яёa-z]{{{shortest},}}"))).alias("run")).distinct()
    parts = F.transform(F.sequence(F.lit(1), F.length("run") - shortest + 1), lambda i: F.substring("run", i, F.lit(shortest)))
    grams = runs.withColumn("gram", F.explode(F.array_distinct(parts)))
    wanted = asked.filter("word IS NOT NULL").select("case_id", "word", F.substring("word", 1, shortest).alias("gram")).distinct()
    held = grams.join(wanted, ["case_id", "gram"]).filter(F.col("run").contains(F.col("word"))).select("case_id", "word").distinct().withColumn("hit", F.lit(1))
    by_topic = asked.join(held, ["case_id", "word"], "left").groupBy("case_id", "topic_no").agg(F.count("word").alias("n"), F.count("hit").alias("hits"))
    found = (F.col("n") > 0) & (F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("n") / 3)))
    return by_topic.groupBy("case_id").agg(F.count("*").alias("topics"), F.count_if(found).alias("found")).withColumn("recall", F.round(F.col("found") / F.col("topics"), 3))


def table_facts(text: Column) -> Column:
    """What a rendered table states, in either of two layouts: recoverable_pct, tailings_tonnage, the first six size classes."""
    number = lambda p: F.replace(F.nullif(F.regexp_extract(text, f"(?iU){p}", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    share = F.coalesce(number(r"Итого извлекаемый металл в хвостах:\s*([\d.,]+)\s*%"), number(r"Итого извлекаемый металл\s*\|\s*\|\s*([\d.,]+)"))
    tonnage = F.coalesce(number(r"Отвальные хвосты:\s*([\d.,eE+-]+)\s*т"), number(r"Отвальные хвосты\s*\|\s*([\d.,]+)"))
    sizes = F.slice(tx.all_of(text, r"(?iU)(?:\|\s*|-\s*)([+\-]?\d+(?:\s*\+\s*\d+)?)\s*мкм", 1), 1, 6)
    return F.struct(share.alias("recoverable_pct"), tonnage.alias("tailings_tonnage"), sizes.alias("grain_classes"))


def case_documents(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """The processed document of each case (case_id, stem): of those whose id begins with the stem the least id."""
    length = F.length("stem")
    sized = cases.select("case_id", "stem", length.alias("n"))
    lengths = [r[0] for r in sized.select("n").distinct().collect()]  # as many as stems have different lengths
    heads = docs.select(F.col("doc_id").alias("found"), F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("doc_id", 1, n).alias("stem")) for n in lengths])).alias("h")).select("found", "h.*") if lengths else docs.select(F.col("doc_id").alias("found"), F.lit(0).alias("n"), F.lit("").alias("stem")).limit(0)
    best = heads.join(sized.select("n", "stem").distinct(), ["n", "stem"]).groupBy("stem").agg(F.min("found").alias("doc_id"))
    return sized.drop("n").join(best, "stem", "left").select("case_id", "doc_id")


def case_report(cases: DataFrame, recall: DataFrame, facts: DataFrame, hits: DataFrame, runs: DataFrame, support: DataFrame) -> DataFrame:
    """A row for each case: topics and recall (V03), facts (V04: case_id, facts), hit (V05), the run's metrics (J19, by
    case_id) and citation support (V06, by case_id). What a case has no row for is null, a recall 0."""
    out = cases.select("case_id").distinct()
    for df in (recall.select("case_id", "topics", "found", "recall"), facts.select("case_id", "facts"), hits.select("case_id", "hit"), runs.select("case_id", "total", "n_approved", "avg_score", "grounding_rate", "run_index"), support.select("case_id", "support")):
        out = out.join(df, "case_id", "left")
    return out.withColumn("recall", F.coalesce("recall", F.lit(0.0)))


def failed_labels(checked: DataFrame, most: int = 10) -> DataFrame:
    """The checks (J05 to J13) that fail most often: (key, required, n)."""
    return checked.filter(~F.col("passed")).groupBy("key").agg(F.max("required").alias("required"), F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(most)


def graph_share(measures: DataFrame) -> DataFrame:
    """The share of hypotheses whose graph is incomplete: `completeness` below 0.5."""
    return measures.agg(F.count("*").alias("total"), F.count_if(F.col("completeness") < 0.5).alias("incomplete"), F.round(F.avg((F.col("completeness") < 0.5).cast("double")), 3).alias("share"))


def index_summary(files: DataFrame, indexed: DataFrame, results: DataFrame) -> DataFrame:
    """After a batch ingest: files (path), how many were indexed before (path), and of the others those that came in with
    chunks, those without, and those that failed. results: path, n_chunks, error."""
    f = files.select("path").distinct().join(indexed.select("path").distinct().withColumn("before", F.lit(1)), "path", "left").join(results.select("path", "n_chunks", "error"), "path", "left")
    new = F.col("before").isNull()
    ok = new & F.col("error").isNull() & (F.coalesce("n_chunks", F.lit(0)) > 0)
    return f.agg(
        F.count("*").alias("files"), F.count("before").alias("indexed_before"), F.count_if(ok).alias("ingested"), F.count_if(new & F.col("error").isNull() & (F.coalesce("n_chunks", F.lit(0)) == 0)).alias("skipped"),
        F.count_if(new & F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum(F.when(ok, F.col("n_chunks"))), F.lit(0)).alias("chunks"),
    )


def retrieval_hit(cases: DataFrame, hits: DataFrame, by: str = "case_id") -> DataFrame:
    """Whether a case's id, or its first 12 characters, stands in a retrieved doc_id. cases: case_id, doc_id; hits: case_id,
    doc_id; where many cases share a query's hits, both have the column `by` instead. A whole id stands nowhere that its first 12 characters do not."""
    own = cases.select("case_id", by, F.substring("doc_id", 1, 12).alias("__id")) if by != "case_id" else cases.select("case_id", F.substring("doc_id", 1, 12).alias("__id"))
    met = containing(hits.select(by, F.col("doc_id").alias("__got")), "__got", own, "__id", [by]).select(by, "__id").distinct().withColumn("__met", F.lit(True))
    return own.join(met, [by, "__id"], "left").groupBy("case_id").agg(F.coalesce(F.max("__met"), F.lit(False)).alias("hit"))


def citation_support(hyps: DataFrame, terms: int = 5) -> DataFrame:
    """The share of hypotheses (run_id, text, snippet) with one of their first terms in their first snippet; terms go by place."""
    words = F.slice(F.array_distinct(tx.all_of(F.lower("text"), tx.SMALL + "{6,}")), 1, terms)
    return hyps.groupBy("run_id").agg(F.round(F.avg(F.exists(words, lambda w: F.lower(F.coalesce("snippet", F.lit(""))).contains(w)).cast("double")), 3).alias("support"))


def aggregate_report(cases: DataFrame) -> DataFrame:
    """Means over cases (run_index, recall, approved, total), and the pooled approval rate."""
    return cases.agg(F.count("*").alias("cases"), F.avg("run_index").alias("run_index"), F.avg("recall").alias("recall"), (F.sum("approved") / F.sum("total")).alias("approval_rate"))


def commonest_issues(issues: DataFrame, most: int = 12, each: int = 3, head: int = 120) -> DataFrame:
    """The commonest issues (hyp_id, at, issue), of the first `each` of a hypothesis and by their first characters."""
    first = ranked(issues, ["hyp_id"], [F.asc("at")], each, "n")
    counted = first.groupBy(F.substring("issue", 1, head).alias("issue")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "issue").limit(most)


def scenario_summary(verdicts: DataFrame) -> DataFrame:
    """Per scenario its hypotheses, approvals, mean compliance and incomplete graphs."""
    return verdicts.groupBy("scenario").agg(F.count("*").alias("total"), F.count_if("approved").alias("approved"), F.avg("compliance_pct").alias("avg_compliance"), F.count_if(F.col("completeness") < 0.5).alias("incomplete_graphs"))


def scenario_details(verdicts: DataFrame, checked: DataFrame, head: int = 100, most: int = 3) -> DataFrame:
    """A row for each hypothesis of a scenario: scenario, hyp_id, approved, overall_score, compliance_pct, failed (the required checks that
    it fails, in order), text (its beginning) and issues (the first `most`). verdicts: these columns and issues; checked: judging.checks(), with label where
    keys have one."""
    label = "label" if "label" in checked.columns else "key"
    failed = checked.filter("required AND NOT passed").groupBy("hyp_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col(label).alias("label")))), lambda x: x["label"]).alias("failed"))
    none = F.array().cast("array<string>")
    return verdicts.join(failed, "hyp_id", "left").select("scenario", "hyp_id", "approved", "overall_score", "compliance_pct", F.coalesce("failed", none).alias("failed"), F.substring("text", 1, head).alias("text"), F.slice(F.coalesce("issues", none), 1, most).alias("issues"))


def readiness(counts: DataFrame, floors: dict[str, int] | None = None) -> DataFrame:
    """A message for each count (name, n) under its floor."""
    floors = floors or {"vectors": 10, "nodes": 1, "chunks": 3}
    f = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))])
    state = F.when(F.col("n") < F.try_element_at(f, F.col("name")), F.concat(F.lit("под порогом: "), "name")).otherwise(F.lit("ok"))
    return counts.withColumn("state", state)
