"""From problems to proposals: metadata, contexts, analogies and the whole retrieval and proposal plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from . import business, citations, graphs, hypotheses, judging, retrieval
from .lineage import kept, settled, spread
from .retrieval import ranked

# How constraints are led in, in this order; materials; fields of documents in texts.
SEPARATORS = (r"\n\s*ограничени[яй]\s*:\s*", r"\n\s*constraints\s*:\s*", r"\.\s*ограничени[яй]\s*:\s*", r"\.\s*constraints\s*:\s*")
MATERIALS = ("хвост", "руда", "концентрат", "шлам", "пульпа")
FIELDS = (
    ("date", r"(?:дата|date)\s*[:=]?\s*(\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}\.\d{1,2}\.\d{2,4})"),
    ("pH", r"pH\s*[:=]?\s*(\d+(?:[.,]\d+)?(?:\s*[-–—]\s*\d+(?:[.,]\d+)?)?)"),
    ("temperature_C", r"температур[аы]?\s*[:=]?\s*(\d+(?:[.,]\d+)?)"),
    ("reagent_dosage", r"(\d+(?:[.,]\d+)?)\s*(?:кг|г)\s*/?\s*т"),
    ("recovery_pct", r"(?:извлекаем\w+\s+металл\s+в\s+хвостах|извлечени[ея])\s*[:=]?\s*(\d+(?:[.,]\d+)?)\s*%"),
    ("grade_pct", r"содержани[ея]\s*[:=]?\s*(\d+(?:[.,]\d+)?)\s*%"),
    ("Cu_recovery", r"Cu[^\d]*(\d+(?:[.,]\d+)?)\s*%"),
    ("yield", r"выход\s*[:=]?\s*(\d+(?:[.,]\d+)?)\s*%"),
)
AUTHORS = r"(?iU)(?:автор|authors?|исследователь)\s*[:=]\s*([^\n;]{3,80})"
STEPS = r"(?iU)(?:шаг|этап|step)\s*\d+[:.]?\s*([^\n]{10,120})"


def split_constraints(df: DataFrame, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """Constraints taken out of the problem where they are empty, by the first separator that leaves two parts."""
    p, c = tx.strip(F.coalesce("problem", F.lit(""))), tx.strip(F.coalesce("constraints", F.lit("")))
    out = F.struct(p.alias("problem"), c.alias("constraints"))
    for s in reversed(separators):
        head = F.regexp_replace(tx.strip(F.regexp_extract(p, f"(?isU)^(.*?){s}(.*)$", 1)), r"\.+$", "")
        rest = tx.strip(F.regexp_extract(p, f"(?isU)^(.*?){s}(.*)$", 2))
        out = F.when((c == "") & (head != "") & (rest != ""), F.struct(head.alias("problem"), rest.alias("constraints"))).otherwise(out)
    return df.withColumn("__s", out).withColumns({"problem": F.col("__s.problem"), "constraints": F.col("__s.constraints")}).drop("__s")


def metadata(text: Column, fields: Sequence[tuple[str, str]] = FIELDS) -> Column:
    """A struct of the fields that a text states, three authors and eight steps at most, material and sample."""
    got = [F.nullif(F.regexp_extract(text, f"(?iU){p}", 1), F.lit("")).alias(k) for k, p in fields]
    material = F.lit(None).cast("string")
    for m in reversed(MATERIALS):
        material = F.when(F.lower(text).contains(m), F.lit(m)).otherwise(material)
    authors = F.slice(F.array_distinct(F.transform(tx.all_of(text, AUTHORS, 1), tx.strip)), 1, 3).alias("authors")
    sample = F.nullif(F.regexp_extract(text, r"(?iU)(?:проба|образец|sample)\s*[#№]?\s*(\w+)", 1), F.lit("")).alias("sample_id")
    return F.struct(*got, authors, F.slice(tx.all_of(text, STEPS, 1), 1, 8).alias("steps"), material.alias("material"), sample)


def process_uri(material: Column, process: str = "flotation") -> Column:
    """T21."""
    return F.concat(F.lit(f"allotrope:process/{process}/"), F.replace(F.coalesce(material, F.lit("ore")), F.lit(" "), F.lit("-")), F.lit("-laboratory-assay"))


def entities(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, name, type) and relations (doc_id, source, target, type) of metrics (doc_id, key, kind, value):
    every parameter of a document modifies its process and affects its properties."""
    e = metrics.select("doc_id", F.concat_ws("=", "key", "value").alias("name"), F.when(F.col("kind") == "parameter", "Parameter").when(F.col("kind") == "process", "Process").otherwise("Property").alias("type")).distinct()
    a, b = e.filter("type = 'Parameter'").withColumnRenamed("name", "source").drop("type"), e.filter("type <> 'Parameter'").withColumnRenamed("name", "target")
    relation = F.when(F.col("type") == "Process", "MODIFIES").otherwise("AFFECTS")
    return e, a.join(b, "doc_id").select("doc_id", "source", "target", relation.alias("type"))


def ner_sample(text: Column, measurements: Column, parameters: Column, most: int = 4500) -> Column:
    """What an entity extractor is shown of a text: its KPI lines (8 at most), what is known of it (maps), and the whole
    text, or of one over `most` characters its first 2000 and last 1500; cut at `most`."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: tx.strip(x).startswith("# KPI-сводка") | F.lower(x).contains("извлекаемый металл"))
    known = F.when((F.coalesce(F.size(measurements), F.lit(0)) > 0) | (F.coalesce(F.size(parameters), F.lit(0)) > 0), F.concat(F.lit("Structured: "), F.to_json(F.struct(measurements.alias("measurement_results"), parameters.alias("process_parameters")))))
    body = F.when(F.length(text) <= most, F.array(text)).otherwise(F.array(F.substring(text, 1, 2000), F.substring(text, -1500, 1500)))
    parts = F.concat(F.array(F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 8), "\n")), known), body)
    return F.substring(F.array_join(F.filter(parts, lambda x: F.coalesce(tx.strip(x), F.lit("")) != ""), "\n\n---\n\n"), 1, most)


def whole_context(hits: DataFrame, nodes: DataFrame, links: DataFrame, gaps: DataFrame, most: int = 900) -> DataFrame:
    """Per query its hits as numbered blocks (source, score and a mark for examples), 10 nodes, 8 links and 5 gaps at most. hits:
    query_id, rank, doc_id, source, score, text, is_example; nodes: query_id, at, id, type, source; links: query_id, at, source,
    target, type; gaps: R23."""
    tag = F.when(F.coalesce("is_example", F.lit(False)), F.lit(" [ПРИМЕР]")).otherwise(F.lit(""))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"), tag, F.lit(" doc_id="), F.col("doc_id").cast("string"), F.lit(" source="), F.coalesce("source", F.lit("")), F.lit(" score="), F.format_string("%.3f", F.col("score").cast("double")), F.lit("\n"), F.substring("text", 1, most))
    some = lambda df, at, keep, text: ranked(df, ["query_id"], [F.asc(at)], keep, "__n").select("query_id", F.col("__n").alias("at"), text.alias("line"))
    origin = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" ["), "source", F.lit("]"))).otherwise(F.lit(""))
    n = some(nodes, "at", 10, F.concat(F.lit("  - "), "type", F.lit(": "), "id", origin))
    k = some(links, "at", 8, F.concat(F.lit("  → "), "source", F.lit(" --"), "type", F.lit("--> "), "target"))
    g = some(gaps, "rank", 5, F.concat(F.lit("  - ["), "severity", F.lit("] "), "topic"))
    named = lambda df, text: df.select("query_id").distinct().select("query_id", F.lit(0).alias("at"), F.lit(text).alias("line"))
    graph = named(nodes, "\nKnowledge graph excerpt:").withColumn("part", F.lit(1)).unionByName(n.withColumn("part", F.lit(2))).unionByName(k.join(nodes.select("query_id").distinct(), "query_id", "left_semi").withColumn("part", F.lit(3)))
    missing = named(gaps, "\nKnowledge gaps (address in hypotheses where possible):").withColumn("part", F.lit(4)).unionByName(g.withColumn("part", F.lit(5)))
    lines = hits.select("query_id", F.col("rank").alias("at"), block.alias("line")).withColumn("part", F.lit(0)).unionByName(graph).unionByName(missing)
    joined = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("part", "at", "line")))["line"].alias("l"))
    return joined.select("query_id", F.array_join("l", "\n\n").alias("context"))


def whole_prompts(queries: DataFrame, contexts: DataFrame, hints: DataFrame, conflicts: DataFrame, topics: DataFrame) -> DataFrame:
    """A prompt for each query, for any generator outside: problem, constraints, hints, at most 12 topics to spread over n
    hypotheses (T34), context and conflicts. queries: query_id, problem, constraints, n; conflicts: R22; topics: query_id, at, topic."""
    lines = lambda df, at, text, head: df.groupBy("query_id").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(F.struct(at, text.alias("line"))))["line"], "\n")).alias("x"))
    n = tx.hypothesis_count(F.col("n"))
    first = ranked(topics, ["query_id"], [F.asc("at")], 12, "no")
    parts = {
        "__hints": lines(hints, "rank", F.concat(F.lit("- "), "hint"), "Case hints (ground every claim in snippet):\n"),
        "__topics": lines(first, "no", F.concat(F.lit("  "), F.col("no").cast("string"), F.lit(". "), "topic"), "Directions to distribute:\n"),
        "__conflicts": lines(conflicts, "rank", F.concat(F.lit("- "), "message"), "Detected conflicts in sources:\n"),
    }
    out = queries.join(contexts, "query_id", "left")
    for name, df in parts.items():
        out = out.join(df.withColumnRenamed("x", name), "query_id", "left")
    text = F.concat_ws("\n\n", F.concat(F.lit("Target problem:\n"), "problem"), F.concat(F.lit("Constraints:\n"), F.coalesce(F.nullif("constraints", F.lit("")), F.lit("none"))), "__hints", "__topics", F.concat(F.lit("Relevant sources and knowledge graph:\n"), "context"), "__conflicts", F.concat(F.lit("Hypotheses: "), n.cast("string")))
    return out.select("query_id", text.alias("prompt"))


def context(hits: DataFrame, most: int = 900) -> DataFrame:
    """A query's hits as numbered blocks."""
    block = F.format_string("[%d] %s (%.2f)\n%s", F.col("rank").cast("int"), F.col("doc_id").cast("string"), F.col("score").cast("double"), F.substring("text", 1, most))
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b"))))["b"].alias("blocks")).select("query_id", F.array_join("blocks", "\n\n").alias("context"))


def prompts(queries: DataFrame, contexts: DataFrame, hints: DataFrame) -> DataFrame:
    """One prompt for each query, for any generator outside: problem, constraints, hints in order, context."""
    h = hints.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "hint")))["hint"].alias("hints"))
    j = queries.join(contexts, "query_id", "left").join(h, "query_id", "left")
    return j.select("query_id", F.concat_ws("\n\n", "problem", F.nullif("constraints", F.lit("")), F.array_join("hints", "\n"), "context").alias("prompt"))


def analogies(hyps: DataFrame, hits: DataFrame, topic: str = tx.SMALL + "{6,}", most: int = 6) -> DataFrame:
    """The hit (query_id, rank, doc_id, text) that is the best analogy of each hypothesis (hyp_id, query_id, text): 2 for each
    topic they share, 3 for each of the hit's own, 4 for each close parameter; scores under 3 do not count.
    Topics are a text's distinct long words, the first `most`."""
    labels = lambda c: F.slice(F.array_distinct(tx.all_of(F.lower(c), topic)), 1, most)
    # hypotheses of one query and wording have one analogy: it is looked for once
    h = hyps.select("query_id", "text").distinct().select("query_id", "text", labels(F.col("text")).alias("a"), tx.parameters(F.col("text")).alias("p"))
    g = hits.select("query_id", "rank", "doc_id", labels(F.col("text")).alias("b"), tx.parameters(F.col("text")).alias("q")).filter(F.size("b") > 0)
    close = F.size(F.filter(F.map_keys("p"), lambda k: F.coalesce(F.abs(F.try_element_at("p", k) - F.try_element_at("q", k)) < F.greatest(F.lit(1.0), F.try_element_at("p", k) * 0.25), F.lit(False))))
    score = 2 * F.size(F.array_intersect("a", "b")) + 3 * F.size(F.array_except("b", "a")) + 4 * close
    scored = h.join(g, "query_id").withColumn("score", score).filter("score >= 3")
    first = F.struct("score", -F.col("rank"))
    best = scored.groupBy("query_id", "text").agg(F.max_by(F.struct("doc_id", "score", "rank"), first).alias("best")).select("query_id", "text", "best.*")
    own = hyps.select("hyp_id", "query_id", "text").join(best, ["query_id", "text"])
    return own.groupBy("hyp_id").agg(F.max_by(F.struct("doc_id", "score"), first).alias("best")).select("hyp_id", "best.doc_id", "best.score")


# Words that are no parameter to compare by, and the sentences of an analogy.
_COMMON = ("извлечение", "повышение", "флотация")


def analogy_texts(hyps: DataFrame, hits: DataFrame, topic: str = tx.SMALL + "{6,}", most: int = 6, first: int = 8) -> DataFrame:
    """B05 in words: (hyp_id, kind, doc_id, analogy) for each hypothesis (hyp_id, query_id, text, mechanism).

    kind "topic": the hit that analogies() chose. "token": where none scores, the first of the query's `first` hits that has one of the
    hypothesis's words of 7 letters or more, by the first such word. "general": where none has.
    """
    labels = lambda c: F.slice(F.array_distinct(tx.all_of(F.lower(c), topic)), 1, most)
    head = lambda c: F.concat(F.lit("«"), F.substring(c, 1, 140), F.lit("…»"))
    wording = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("mechanism", F.lit("")))
    own = hyps.select("hyp_id", "query_id", "text", wording.alias("wording"))
    best = settled(analogies(hyps, hits, topic, most))
    g = hits.select("query_id", F.col("doc_id").alias("hit_id"), "rank", F.col("text").alias("hit_text"))
    # a document may have several hits: the best ranked one of those that score as much
    near = own.join(best.select("hyp_id", "doc_id"), "hyp_id").join(g, ["query_id"]).filter(F.col("doc_id") == F.col("hit_id")).groupBy("hyp_id").agg(F.min_by(F.struct("doc_id", "text", "hit_text"), "rank").alias("x")).select("hyp_id", "x.*")
    cross = F.slice(F.array_sort(F.array_except(labels(F.col("hit_text")), labels(F.col("text")))), 1, 3)
    domain = F.when(F.size(cross) > 0, F.concat(F.lit("перенос из домена «"), F.get(cross, 0), F.lit("»"))).otherwise("смежный процесс в корпусе")
    stated = F.array_join(F.transform(F.map_entries(tx.parameters(F.col("hit_text"))), lambda e: F.concat(e["key"], F.lit("≈"), e["value"].cast("string"))), ", ")
    told = F.concat(F.lit("Cross-domain аналогия ("), domain, F.lit("): в "), F.substring(F.col("doc_id").cast("string"), 1, 36), F.lit("… описан похожий механизм"), F.when(stated != "", F.concat(F.lit(" ("), stated, F.lit(")"))).otherwise(""), F.lit(" — "), head(F.col("hit_text")))
    by_topic = near.select("hyp_id", F.lit("topic").alias("kind"), F.col("doc_id").cast("string").alias("doc_id"), told.alias("analogy"))
    rest = own.join(best.select("hyp_id"), "hyp_id", "left_anti")
    tokens = F.filter(tx.all_of(F.lower("wording"), "[а-яёa-z]{7,}"), lambda w: ~w.isin(*_COMMON))
    met = rest.withColumn("tokens", tokens).join(g.filter(F.col("rank") <= first), "query_id").withColumn("low", F.lower("hit_text"))
    met = met.withColumn("token", F.get(F.filter("tokens", lambda w: F.col("low").contains(w)), 0)).filter("token IS NOT NULL")
    met = met.groupBy("hyp_id").agg(F.min_by(F.struct("hit_id", "hit_text", "token"), "rank").alias("x")).select("hyp_id", "x.*")
    by_token = met.select("hyp_id", F.lit("token").alias("kind"), F.col("hit_id").cast("string").alias("doc_id"), F.concat(F.lit("Аналогия по параметру «"), "token", F.lit("» в "), F.substring(F.col("hit_id").cast("string"), 1, 36), F.lit("…: "), head(F.col("hit_text"))).alias("analogy"))
    general = F.concat(F.lit("Аналогия: механизм сопоставим с подходами из корпуса по теме «"), tx.kpi_label(F.col("text"), default=lx.DEFAULT_KPI_LABEL), F.lit("» и смежным процессам в базе знаний."))
    others = rest.join(met.select("hyp_id"), "hyp_id", "left_anti").select("hyp_id", F.lit("general").alias("kind"), F.lit(None).cast("string").alias("doc_id"), general.alias("analogy"))
    return by_topic.unionByName(by_token).unionByName(others)


def counterfactual(hyps: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per hypothesis its leading parameter, and the baseline: the model's, else the mean metric of its query's first ten hits.
    metrics: query_id, rank, text; hyps: hyp_id, query_id, text, baseline, predicted."""
    stated = tx.parameters(F.col("text"))
    mean = metrics.filter("rank <= 10").select("query_id", F.try_element_at(stated, F.lit("metric")).alias("m")).groupBy("query_id").agg(F.avg("m").alias("mean"))
    first = F.coalesce(*[F.when(F.try_element_at("p", F.lit(k)).isNotNull(), F.lit(k)) for k in ("pH", "dosage", "temperature")], F.lit("режим"))
    j = hyps.withColumn("p", stated).join(mean, "query_id", "left").withColumn("baseline", F.coalesce("baseline", "mean"))
    return j.select("hyp_id", first.alias("parameter"), "baseline", (F.col("predicted") - F.col("baseline")).alias("delta"))


def counterfactual_text(problem: Column, kpi: Column, text: Column, median: Column, mean: Column, predicted: Column) -> Column:
    """B06 in words: what stays where nothing is changed, against the model's median or else the hits' mean, and the model's prediction."""
    p = tx.parameters(text)
    stated = lambda key, label: F.concat(F.lit(label), F.try_element_at(p, F.lit(key)).cast("string"))
    param = F.coalesce(stated("pH", "pH="), stated("dosage", "дозировка "), stated("temperature", "температура "), F.lit("ключевой параметр режима"))
    n = lambda c, form="%.2f": F.when(c.isNotNull(), F.format_string(form, c.cast("double")))
    base = F.coalesce(median, mean)
    note = F.coalesce(F.concat(F.lit("медиана "), kpi, F.lit(" по архиву "), n(median)), F.concat(F.lit("среднее "), kpi, F.lit(" в источниках "), n(mean)))
    known = F.concat(
        F.lit("Контрфактуал: при сохранении базового режима ("), note, F.lit(") прогноз "), kpi, F.lit(" остаётся ~"), n(base), F.lit("; при внедрении гипотезы ("), param, F.lit(") ML-модель даёт "), n(predicted),
        F.lit(" (Δ "), n(predicted - base, "%+.2f"), F.lit("). Без изменений KPI по «"), F.substring(problem, 1, 55), F.lit("…» не достигается."),
    )
    other = F.concat(F.lit("Контрфактуал: если НЕ менять "), param, F.lit(", сохраняется текущий уровень "), kpi, F.lit(" по задаче «"), F.substring(problem, 1, 60), F.lit("…»"), F.coalesce(F.concat(F.lit(" ("), note, F.lit(")")), F.lit("")), F.lit(" без целевого прироста."))
    return F.coalesce(known, other)


def relative_source(path: Column, root: str) -> Column:
    """A path below root relative to it; others as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def analysis(hyps: DataFrame, hits: DataFrame, gaps: DataFrame) -> DataFrame:
    """Predictive score where there is no model: 0.45, 0.1 for each parameter that a hit states as well (0.85 at most),
    less 0.06 for each high gap of the query (0.15 at least)."""
    return with_analysis(hyps.select("hyp_id", "query_id", tx.parameters(F.col("text")).alias("__p")), hits, gaps, F.col("__p")).select("hyp_id", "predictive")


def with_analysis(hyps: DataFrame, hits: DataFrame, gaps: DataFrame, parameters: Column) -> DataFrame:
    """hyps with predictive, as analysis() has it. parameters: what a hypothesis's text states."""
    keys = ("pH", "dosage", "metric")
    states = lambda c, k: F.try_element_at(c, F.lit(k)).isNotNull()
    g = hits.select("query_id", tx.parameters(F.col("text")).alias("q"))
    stated = g.groupBy("query_id").agg(*[F.count_if(states("q", k)).alias(f"__{k}") for k in keys])
    both = sum((F.when(states(parameters, k), F.coalesce(f"__{k}", F.lit(0))).otherwise(0) for k in keys), F.lit(0))
    high = gaps.filter("severity = 'high'").groupBy("query_id").agg(F.count("*").alias("__high"))
    score = F.least(F.lit(0.85), 0.45 + 0.1 * both)
    score = F.when(F.col("__high") > 0, F.greatest(F.lit(0.15), score - 0.06 * F.col("__high"))).otherwise(score)
    return hyps.join(stated, "query_id", "left").join(high, "query_id", "left").withColumn("predictive", F.round(score, 3)).select(*hyps.columns, "predictive")


def corpus_graph(docs: DataFrame, metrics: DataFrame, keywords: Sequence[str], most: int = 24) -> DataFrame:
    """Edges (publication, node, type) from documents whose text holds a keyword to their metrics (doc_id, key, value) that name
    one; all edges are kept, not only a node's first."""
    words = [k.lower() for k in keywords]
    hit = docs.filter(tx.contains_any(F.lower(F.substring("text", 1, 800)), words)).select("doc_id")
    named = metrics.filter(tx.contains_any(F.lower("key"), words) | tx.contains_any(F.lower("value"), words))
    edges = named.join(hit, "doc_id").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("publication"), F.substring(F.concat_ws("=", "key", "value"), 1, 50).alias("node"), F.lit("CITED_BY").alias("type")).distinct()
    return edges.orderBy("publication", "node").limit(most)


# How a KPI stands in a document's text, and the measurement that is one.
_RECOVERABLE, _RECOVERABLE_KEY, _KPI_TAG = r"(?iU)итого\s+извлекаем\w*\s+металл[^.\n]{0,40}(\d+[.,]\d+)", "recoverable_metal_pct", "enterprise_kpi"


def whole_corpus_graph(docs: DataFrame, metrics: DataFrame, keywords: Sequence[str], most: int = 24, first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the documents that hold a keyword in title, source, tags, metrics or the first 800 characters of the text.

    nodes: at, id, type, title, source: each such document as a Publication, its recoverable share, its metrics that name a keyword
    (Parameter or Property) and the share its text states, each once, by document and place. links: at, source, target, type (REPORTS, CITED_BY): all
    of a document's, or with first_only only those to a node that it is the first to have. The first `most` of both. docs: doc_id, title, source,
    text, tags; metrics: doc_id, at, key, value, bucket (process_parameters or measurement_results).

    A document brings a node at least, so that the first `most` documents are enough.
    """
    words = [k.lower() for k in keywords]
    spoken = metrics.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "key", F.col("value").cast("string")))), " ").alias("__m"))  # a document's own metrics
    blob = F.lower(F.concat_ws(" ", "title", F.substring("text", 1, 800), "source", F.array_join("tags", " "), "__m"))
    hit = settled(docs.join(spoken, "doc_id", "left").filter(tx.contains_any(blob, words)).orderBy("doc_id").limit(most).drop("__m"))
    publication = F.concat(F.lit("doc:"), F.substring(F.col("doc_id").cast("string"), 1, 24))
    number = F.regexp_extract(F.lower(F.substring("text", 1, 800)), _RECOVERABLE, 1)
    stated = F.array_contains("tags", _KPI_TAG) & (number != "")
    none = F.lit(None).cast("string")
    own = hit.select("doc_id", publication.alias("pub"), F.lit(-2).cast("long").alias("place"), publication.alias("id"), F.lit("Publication").alias("type"), none.alias("link"), F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), "source")
    m = metrics.join(hit.select("doc_id", publication.alias("pub")), "doc_id").filter(F.col("value").isNotNull()).withColumns({"value": F.col("value").cast("string"), "in_words": tx.contains_any(F.lower("key"), words) | tx.contains_any(F.lower(F.col("value").cast("string")), words)})
    row = lambda df, place, id_, type_, link: df.select("doc_id", "pub", place.cast("long").alias("place"), id_.alias("id"), type_.alias("type"), F.lit(link).alias("link"), none.alias("title"), none.alias("source"))
    measured = F.col("bucket") == "measurement_results"
    shares = row(m.filter(measured & (F.col("key") == _RECOVERABLE_KEY)), F.lit(-1), F.concat(F.lit("KPI recovery "), "value", F.lit("%")), F.lit("Property"), "REPORTS")
    named = row(m.filter("in_words"), F.col("at") + F.when(measured, 1 << 20).otherwise(0), F.substring(F.concat_ws("=", "key", "value"), 1, 50), F.when(measured, "Property").otherwise("Parameter"), "CITED_BY")
    told = row(hit.withColumn("pub", publication).filter(stated), F.lit(1 << 40), F.concat(F.lit("KPI "), number, F.lit("%")), F.lit("Property"), "REPORTS")
    entries = settled(ranked(own.unionByName(shares).unionByName(named).unionByName(told), ["id"], [F.asc("doc_id"), F.asc("place")], None, "turn"))
    order = [F.asc("doc_id"), F.asc("place"), F.asc("id")]
    nodes = ranked(entries.filter("turn = 1"), [], order, most, "at").select("at", "id", "type", "title", "source")
    links = entries.filter("link IS NOT NULL" + (" AND turn = 1" if first_only else ""))
    links = ranked(links, [], order, most, "at").select("at", F.col("pub").alias("source"), F.col("id").alias("target"), F.col("link").alias("type"))
    return nodes, links


def mandatory(docs: DataFrame, summaries: DataFrame, most: int = 1400) -> DataFrame:
    """Hits that a case always brings: brainstorm documents (their beginning) and KPI tables (doc_id, line); KPIs first. docs: query_id, doc_id, source, title, text."""
    blob = F.lower(F.concat_ws(" ", "source", "title"))
    storm = docs.filter(blob.contains("гипотез") | blob.contains("brainstorm")).select("query_id", "doc_id", F.substring("text", 1, most).alias("text"), F.lit("brainstorm").alias("kind"))
    low = F.lower("source")
    kpis = summaries.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("text"))
    table = docs.filter(low.endswith(".xlsx") & (low.contains("хвост") | low.contains("tailings"))).select("query_id", "doc_id").join(kpis, "doc_id").select("query_id", "doc_id", "text", F.lit("kpi").alias("kind"))
    return table.union(storm).withColumns({"chunk_index": F.lit(0), "score": F.lit(1.0), "example_score": F.lit(1.0)})


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, extra: DataFrame, k: int = 12, inject: int = 4) -> DataFrame:
    """The whole retrieval for all queries in one plan: vectors, rerank, quality, dedupe, injection, neighbours.
    chunks: doc_id, chunk_index, text, source, vec_id (chunks may share a vector); queries: query_id, query_vector, problem,
    constraints, dirs (folders of the query's cases, whose sources R12 boosts)."""
    first = max(retrieval.FIRST_STAGE * k, retrieval.LEAST_FIRST_STAGE)
    near = retrieval.vector_top_k(vectors, queries.select("query_id", "query_vector"), first).drop("rank")
    words = queries.select("query_id", tx.keywords(F.concat_ws(" ", "problem", "constraints")).alias("keywords"), "dirs")
    place = [F.asc("vec_id"), F.asc("doc_id"), F.asc("chunk_index")]
    chunks = kept(chunks.withColumn("__row", F.monotonically_increasing_id()), "chunks")  # cut once, read by column
    # chunks may share a vector: a query needs its best vectors only until these have `first` chunks, and of a vector no more; texts come last
    ids = settled(ranked(chunks.select("vec_id", "doc_id", "chunk_index", "__row"), ["vec_id"], [*place[1:], F.asc("__row")], first, "__of").drop("__of"))
    held = ids.groupBy("vec_id").agg(F.count("*").alias("__held"))
    before = F.coalesce(F.sum("__held").over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = near.join(held, "vec_id").withColumn("__before", before).filter(F.col("__before") < first).drop("__held", "__before")
    hits = ranked(needed.join(ids, "vec_id"), ["query_id"], [F.desc("score"), *place, F.asc("__row")], first).join(words, "query_id")
    hits = hits.join(chunks.select("__row", "text", "source"), "__row")
    best = retrieval.best_of_few(hits, boost=retrieval.source_boost(F.col("source"), F.col("dirs"))).select("query_id", "doc_id", "chunk_index", "vec_id", "score", "rerank_score")
    placed = settled(ranked(best, ["query_id"], [F.desc("rerank_score"), *place]))
    merged = retrieval.inject(placed, extra, inject, k)
    return retrieval.expand_neighbours(merged, chunks, k)


def case_extras(routes: DataFrame, brought: DataFrame, k: int = 12, inject: int = 4) -> DataFrame:
    """What the cases (query_id, dir) of each query bring (dir, doc_id, chunk_index, text, ...). Of a case only the first
    `inject` that are no hits yet can go in, so that its first ones, as many as these and the first stage's hits, stand for all."""
    most = inject + max(retrieval.FIRST_STAGE * k, retrieval.LEAST_FIRST_STAGE)
    first = ranked(brought.withColumn("boost", tx.kpi_boost(F.col("text"))), ["dir"], retrieval.injection_order(F.col("boost")), most, "__n").drop("__n")
    return routes.select("query_id", "dir").join(first, "dir").drop("dir")


def propose(samples: DataFrame, reviews: DataFrame, problem: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Supplied samples to ordered verdicts: items, sanitising, merging, checks, verdict, order.
    Grounding is taken from whether an item names a source with a snippet. columns: those that are wanted beside the order's own, as what
    is ordered is sorted and kept with all it has; none given: all."""
    found = hypotheses.items(samples).select("run_id", "sample_no", "at", "item.*").withColumns(
        {"novelty": F.coalesce("novelty_score", F.lit(5.0)), "feasibility": F.coalesce("feasibility_score", F.lit(5.0)), "expected_value": F.coalesce("expected_value_score", F.lit(5.0)),
         "risk_technical": F.col("risk.technical"), "risk_economic": F.col("risk.economic"), "sources": F.coalesce("sources", F.array().cast("array<struct<doc_id:string,snippet:string>>"))}
    )
    h = hypotheses.numbered(hypotheses.merge_samples(hypotheses.sanitized(hypotheses.undefaulted(found))))
    joined = judging.with_reviews(judging.with_compliance(h, problem), reviews)
    counted = joined.withColumns({"source_grounded": F.exists("sources", lambda s: F.length(s["snippet"]) >= 20), "n_issues": F.col("mandatory_total") - F.col("mandatory_passed"), "n_constraint_issues": F.lit(0)})
    v = judging.verdict(counted).withColumns({"composite": judging.composite()}).withColumn("objective", judging.objective())
    v = v if columns is None else v.select(*dict.fromkeys((*judging.ORDERED_BY, *columns)))
    return judging.output_order(settled(v))  # a range sort reads its input twice


#: So many wordings at most, and bytes of them as JSON, go to every task (and through the driver).
WORDINGS, WORDING_BYTES = 100_000, 16 << 20


def enriched(hyps: DataFrame, hits: DataFrame, gaps: DataFrame, no_capex: Column) -> DataFrame:
    """Hypotheses (with query_id, problem) after their enrichment: the structured roadmap as their roadmap (B09 to B11),
    predictive (B07), business_case (B04), graph_issues and completeness (H14 to H16), and the composite score (J02)."""
    words = [c for c in ("text", "mechanism", "reasoning", "problem", "roadmap", "graph", "chunk_text") if c in hyps.columns]
    # hypotheses of one wording have their patterns searched once, and in its row: nothing is exploded
    told = graphs.told_measures(spread(hyps.select(*words).distinct(), *words))
    told = told.withColumns({"__lines": business.roadmap_told(F.col("text"), F.col("roadmap")), "__p": tx.parameters(F.col("text")), "target_kpi": tx.kpi_label(F.col("problem")), "__stated": business.stated_delta(F.concat_ws(" ", "text", "reasoning"))})
    told = settled(told.withColumnsRenamed({c: f"__w_{c}" for c in words}))
    same = F.lit(True)
    for c in words:
        same = same & F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    small = told.count() <= WORDINGS and (told.agg(F.sum(F.octet_length(F.to_json(F.struct(*told.columns))))).first()[0] or 0) <= WORDING_BYTES
    h = hyps.join(F.broadcast(told) if small else told, same).drop(*[f"__w_{c}" for c in words])
    h = with_analysis(h, hits, gaps, F.col("__p"))
    h = h.withColumn("delta_pct", F.coalesce("__stated", business.expected_delta(F.lit(None).cast("string"), F.col("expected_value"))))
    h = business.with_business_case(h, F.col("problem"), no_capex, F.size("sources"))
    source = F.try_element_at("sources", F.lit(1))["doc_id"]
    h = h.withColumns({"n_sources": F.size("sources"), "n_sourced": F.col("n_given") + F.when(source.isNotNull(), F.col("n_own")).otherwise(0)})
    h = graphs.validate(h).withColumnRenamed("issues", "graph_issues").withColumns({"completeness": graphs.completeness(), "roadmap": F.col("__lines")})
    return h.select(*hyps.columns, "predictive", "business_case", "graph_issues", "completeness", judging.composite(completeness=F.col("completeness")).alias("composite"))


def generate(problems: DataFrame, hits: DataFrame, samples: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """From problems (query_id, problem, constraints), what was retrieved for them (hits of retrieve(): query_id, rank, doc_id,
    text, score) and supplied samples (run_id = query_id, sample_no, raw) to ordered verdicts. Hypotheses are settled three times, as
    the steps behind read them often.

    Constraints are split off the problem (T15), gaps found (R23), items merged and numbered (H01 to H07), citations cleaned
    and aligned against the hits (C08 to C10), hypotheses enriched (J04), grounded (C11) and held against the constraints (J16) and all
    twelve checks (J05 to J15), then judged, scored and ordered (J17 to J22). Returned: gaps, hypotheses, sources,
    and summary (J21), each to be kept by run id (S22).
    """
    asked = split_constraints(problems).withColumn("keywords", F.transform(tx.keywords(F.concat_ws(" ", "problem", "constraints")), F.lower))
    gaps = retrieval.knowledge_gaps(asked, hits)
    found = hypotheses.items(samples).select("run_id", "sample_no", "at", "item.*").withColumns(
        {"novelty": F.coalesce("novelty_score", F.lit(5.0)), "feasibility": F.coalesce("feasibility_score", F.lit(5.0)), "expected_value": F.coalesce("expected_value_score", F.lit(5.0)),
         "risk_technical": F.col("risk.technical"), "risk_economic": F.col("risk.economic"), "sources": F.coalesce("sources", F.array().cast("array<struct<doc_id:string,snippet:string>>"))}
    )
    h = hypotheses.numbered(hypotheses.merge_samples(hypotheses.sanitized(hypotheses.undefaulted(found)))).withColumn("query_id", F.col("run_id"))
    h = settled(h)
    cited = h.select("hyp_id", "query_id", "text", F.posexplode_outer("sources").alias("at", "s")).select("hyp_id", "query_id", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("s.doc_id", F.lit("unknown")).alias("cited_id"), "s.snippet", F.col("text").alias("hypothesis"))
    sources = settled(hypotheses.clean_sources(cited, hits.withColumn("doc_id", F.col("doc_id").cast("string"))))
    listed = sources.groupBy("hyp_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "snippet"))).alias("sources"))
    h = h.drop("sources").join(listed, "hyp_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<doc_id:string,snippet:string>>")))
    h = h.join(asked.select("query_id", "problem", "constraints"), "query_id")
    h = settled(h)
    h = enriched(h, hits, gaps, tx.contains_any(F.lower("constraints"), lx.NO_CAPEX))
    h = settled(h)
    key = lambda q, d: F.concat_ws("/", q, d)
    corpus = retrieval.doc_corpus(hits).select(key("query_id", F.col("doc_id").cast("string")).alias("doc_id"), "corpus")
    named = sources.join(h.select("hyp_id", "query_id"), "hyp_id").select("hyp_id", key("query_id", "doc_id").alias("doc_id"), "snippet")
    grounded = citations.grounding(named, corpus).select("hyp_id", "source_grounded")
    joined = judging.with_reviews(judging.with_compliance(h, F.col("problem"), judging.WHOLE_CHECKS), reviews).join(grounded, "hyp_id", "left").withColumn("source_grounded", F.coalesce("source_grounded", F.lit(False)))
    joined = judging.with_constraint_issues(joined.withColumn("n_issues", F.col("mandatory_total") - F.col("mandatory_passed")), F.col("constraints"))
    v = judging.verdict(joined)
    ordered = judging.output_order(v.withColumn("objective", judging.objective()))
    return {"gaps": gaps, "sources": sources, "hypotheses": ordered, "summary": judging.run_summary(ordered.drop("compliance_pct"), ordered)}


def default_graph(hyps: DataFrame, problem: Column, label: str = lx.DEFAULT_KPI_LABEL) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a hypothesis without a graph: its KPI, its equipment (H11), pH where it states one, each
    linked to the KPI; the first source is every node's source; ids are kept once whatever their case."""
    source = F.try_element_at("sources", F.lit(1))["doc_id"]
    base = hyps.select("hyp_id", "text", tx.kpi_label(problem, default=label).alias("kpi"), source.alias("source_doc_id"))
    gear = graphs.equipment(hyps).join(base.select("hyp_id", "kpi", "source_doc_id"), "hyp_id").select("hyp_id", F.col("at") + 1, F.col("equipment"), F.lit("Material"), "kpi", "source_doc_id")
    ph = base.filter(tx.matches(F.col("text"), r"pH\s*\d")).select("hyp_id", F.lit(50), F.lit("pH"), F.lit("Parameter"), "kpi", "source_doc_id")
    own = base.select("hyp_id", F.lit(0).alias("at"), F.col("kpi").alias("id"), F.lit("Property").alias("type"), "kpi", "source_doc_id")
    nodes = graphs.distinct_nodes(own.union(gear).union(ph))
    links = nodes.filter("type <> 'Property'").select("hyp_id", F.col("id").alias("source"), F.col("kpi").alias("target"), F.lit("AFFECTS").alias("type"), "at")
    return nodes.drop("kpi"), graphs.distinct_links(links)
