"""Influence graphs and property graphs. nodes: hyp_id, id, type, source_doc_id; links: hyp_id, source, target, type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from .lineage import settled, spread
from .retrieval import ranked

# Phases of a roadmap (pattern, label, order; 0: the step's own number), and known labels.
PHASES = (
    (r"лаборатор|лаб\.|на пробах|1\s*кг", "лабораторная фаза", 1),
    (r"пилот|полупром|промышленн\w*\s+испыт", "пилотная фаза", 2),
    (r"пром|внедрен|эксплуатац", "промышленное внедрение", 3),
    (r"контрол|базов\w+\s+режим", "контрольный опыт", 0),
)
EQUIPMENT = (
    (r"шаров\w*\s+мельниц", "шаровые мельницы"),
    (r"мельниц", "мельницы"),
    (r"гидроциклон", "гидроциклоны"),
    (r"грохот", "грохота"),
    (r"футеровк", "футеровка мельниц"),
    (r"насадок", "насадки гидроциклонов"),
    (r"магнитн\w*\s+сепарац", "магнитная сепарация"),
    (r"сепаратор", "сепаратор"),
    (r"классификатор", "классификатор"),
    (r"циклон", "циклоны"),
)
LABELS = ("Material", "Process", "Property", "Parameter", "Publication", "Equipment")
FALLBACK_LABEL, FALLBACK_RELATION = "Parameter", "CORRELATES_WITH"
RELATIONS = ("AFFECTS", "USED_IN", "CORRELATES_WITH", "MODIFIES", "SUPPRESSES", "VALIDATES", "NEXT_PHASE")
# What names a KPI and a process, tried in order, a process's own name, and reagents.
KPI_WORDS = ("извлечение меди", "извлечение", "cu recovery", "recovery", "себестоимость", "селективность", "восстановление")
PROCESS_WORDS = (
    ("флотац", "флотация"), ("выщелачив", "выщелачив"), ("измельчен", "измельчен"), ("сгущен", "сгущен"), ("магнитн", "магнитная сепарация"),
    ("грохочен", "классификация"), ("классификац", "классификация"),
)
REAGENTS = (
    r"карбоксиметилцеллюлоз[аы]?\s*\(?\s*кмц\s*\)?", r"\bкмц\b", r"сернокисл\w+\s+желез\w+", r"медн\w+\s+купорос\w+", r"сернист\w+\s+натри\w+", r"цианид\w*",
    r"извест\w+", r"ксантогенат\w+", r"собирател\w+", r"депрессант\w+", r"аполярн\w+\s+собирател\w+", r"феррицианид\w+",
)
GANGUE = "минералы пустой породы"


def distinct_nodes(nodes: DataFrame, by: Sequence[str] = ("hyp_id",), clean: bool = False) -> DataFrame:
    """A node once whatever its case, the first (at) one; empty ids go. clean: the ids are clean already."""
    n = (nodes if clean else nodes.withColumn("id", tx.clean_id(F.col("id")))).filter("id <> ''").withColumn("__k", F.lower("id"))
    return ranked(n, [*by, "__k"], [F.asc("at")], 1, "__n").drop("__n", "__k")


def distinct_links(links: DataFrame, by: Sequence[str] = ("hyp_id",), clean: bool = False) -> DataFrame:
    """A link once whatever its ends' case; no loops. clean: the ends are clean already."""
    k = links if clean else links.withColumns({"source": tx.clean_id(F.col("source")), "target": tx.clean_id(F.col("target"))})
    k = k.withColumns({"__s": F.lower("source"), "__t": F.lower("target")})
    k = k.filter((F.col("__s") != F.col("__t")) & (F.col("__s") != "") & (F.col("__t") != ""))
    return ranked(k, [*by, "__s", "__t", "type"], [F.asc("at")], 1, "__n").drop("__n", "__s", "__t")


def equipment(hyps: DataFrame, patterns: Sequence[tuple[str, str]] = EQUIPMENT, most: int = 4) -> DataFrame:
    """The first four kinds of equipment that a text names."""
    named = F.array(*[F.when(tx.matches(F.col("text"), p), F.lit(label)) for p, label in patterns])
    return hyps.select("hyp_id", F.posexplode(F.slice(F.filter(named, lambda x: x.isNotNull()), 1, most)).alias("at", "equipment"))


_NODE, _LINK = "array<struct<id:string,type:string,source_doc_id:string>>", "array<struct<source:string,target:string,type:string>>"


def supplied_graph(raw: Column) -> Column:
    """(nodes, links) of a graph as JSON: nodes are objects with an id or plain strings, links have source or from and
    target or to; what has no id or ends is left out."""
    parts = F.from_json(raw, "nodes array<string>, links array<string>")
    node = lambda x: F.when(tx.strip(x).startswith("{"), F.struct(tx.clean_id(F.coalesce(F.get_json_object(x, "$.id"), F.lit(""))).alias("id"), F.coalesce(F.get_json_object(x, "$.type"), F.lit("Material")).alias("type"), F.nullif(F.get_json_object(x, "$.source_doc_id"), F.lit("")).alias("source_doc_id"))).otherwise(F.struct(tx.clean_id(x).alias("id"), F.lit("Material").alias("type"), F.lit(None).cast("string").alias("source_doc_id")))
    end = lambda x, a, b: tx.clean_id(F.coalesce(F.nullif(F.get_json_object(x, f"$.{a}"), F.lit("")), F.get_json_object(x, f"$.{b}"), F.lit("")))
    link = lambda x: F.struct(end(x, "source", "from").alias("source"), end(x, "target", "to").alias("target"), F.coalesce(F.get_json_object(x, "$.type"), F.lit("AFFECTS")).alias("type"))
    nodes = F.filter(F.transform(F.coalesce(parts["nodes"], F.array().cast("array<string>")), node), lambda n: n["id"] != "")
    links = F.filter(F.transform(F.coalesce(parts["links"], F.array().cast("array<string>")), link), lambda k: (k["source"] != "") & (k["target"] != ""))
    return F.struct(nodes.alias("nodes"), links.alias("links"))


def causal_graph(text: Column, mechanism: Column, source: Column) -> Column:
    """(nodes, links) that a hypothesis's wording gives: its KPI, its process, equipment (H11), values of pH and the first three
    reagents, each with its typed link. text: all wording, mechanism: what stands in for reagents where nothing else is named."""

    def build(low: Column) -> Column:
        kpi = F.lit(lx.DEFAULT_KPI_LABEL)
        for w in reversed(KPI_WORDS):
            kpi = F.when(low.contains(w), F.lit(w)).otherwise(kpi)
        kpi = F.when(low.contains("мед") & low.contains("извлеч"), F.lit("извлечение меди")).otherwise(kpi)
        process = F.lit("процесс обогащения")
        for w, name in reversed(PROCESS_WORDS):
            process = F.when(low.contains(w), F.lit(name)).otherwise(process)
        none = F.array().cast("array<string>")
        any_gear, any_reagent = ("(?U)" + "|".join(f"(?:{p})" for p in ps) for ps in ([p for p, _ in EQUIPMENT], REAGENTS))  # most texts name none: one search tells
        gear = F.when(low.rlike(any_gear), F.slice(F.array_distinct(F.filter(F.array(*[F.when(tx.matches(low, p), F.lit(label)) for p, label in EQUIPMENT]), lambda x: x.isNotNull())), 1, 4)).otherwise(none)
        ph = F.transform(tx.all_of(low, r"(?iU)pH\s*(\d+(?:[.,]\d+)?(?:\s*[-–—]\s*\d+(?:[.,]\d+)?)?)", 1), lambda v: F.concat(F.lit("pH "), F.replace(v, F.lit(","), F.lit("."))))
        named = F.when(low.rlike(any_reagent), F.filter(F.transform(F.concat(*[tx.all_of(low, f"(?iU){p}") for p in REAGENTS]), tx.strip), lambda x: F.length(x) >= 3)).otherwise(none)

        def with_reagents(f: Column) -> Column:
            instead = F.when((F.size(f["gear"]) == 0) & (F.coalesce(mechanism, F.lit("")) != ""), F.array(F.substring(F.substring_index(mechanism, ".", 1), 1, 40))).otherwise(none)
            reagents = F.slice(F.when(F.size(f["named"]) > 0, f["named"]).otherwise(instead), 1, 3)
            return tx.let(F.struct(f["kpi"].alias("kpi"), f["process"].alias("process"), f["gear"].alias("gear"), F.transform(f["ph"], lambda x: tx.clean_id(x)).alias("ph"), F.transform(reagents, lambda x: tx.clean_id(x)).alias("reagents")), lambda p: _assembled(p, low, source))

        return tx.let(F.struct(kpi.alias("kpi"), process.alias("process"), gear.alias("gear"), ph.alias("ph"), named.alias("named")), with_reagents)

    return tx.let(F.lower(text), build)


def _assembled(p: Column, low: Column, source: Column) -> Column:
    """Nodes and links of the parts, whose names are clean."""
    none = F.lit(None).cast("string")
    node = lambda kind, s=source: lambda x: F.struct(x.alias("id"), F.lit(kind).alias("type"), s.alias("source_doc_id"))
    link = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    gangue = low.contains("пуст") & (F.size(p["reagents"]) > 0)
    nodes = F.concat(
        F.array(node("Property")(p["kpi"]), node("Process")(p["process"])), F.transform(p["gear"], node("Material")), F.transform(p["ph"], node("Parameter")), F.transform(p["reagents"], node("Material")),
        F.when(gangue, F.array(node("Material", none)(F.lit(GANGUE)))).otherwise(F.array().cast(_NODE)),
    )
    to_process = lambda kind: lambda x: link(x, p["process"], kind)
    links = F.concat(
        F.transform(p["gear"], to_process("MODIFIES")), F.transform(p["ph"], to_process("MODIFIES")), F.transform(p["reagents"], to_process("USED_IN")), F.array(link(p["process"], p["kpi"], "AFFECTS")),
        F.when(gangue, F.array(link(F.get(p["reagents"], 0), F.lit(GANGUE), "SUPPRESSES"))).otherwise(F.array().cast(_LINK)),
    )
    return F.struct(nodes.cast(_NODE).alias("nodes"), links.cast(_LINK).alias("links"))


def whole_graph(hyps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (hyp_id, id, type, source_doc_id, at), links and states of each hypothesis. hyps: hyp_id, text, mechanism, problem,
    sources, roadmap, and where there are any graph (JSON, H10) and chunk_text (its first hits).

    A supplied graph of under two nodes or no link is filled up from the wording (H12); hits add what their wording gives; nodes
    without a source take the hypothesis's first; the roadmap's states (H13) become nodes, and the first of them
    validates the first property. Nodes and links stand once whatever their case.
    """
    has = lambda c: F.col(c) if c in hyps.columns else F.lit(None).cast("string")
    source = F.try_element_at("sources", F.lit(1))["doc_id"]
    own = hyps.withColumns({"__g": supplied_graph(has("graph")), "__c": causal_graph(F.concat_ws(" ", "text", "mechanism", "problem"), F.col("mechanism"), source)})
    own = own.withColumn("__e", F.when(F.coalesce(has("chunk_text"), F.lit("")) != "", causal_graph(F.concat_ws(" ", "text", has("chunk_text"), "mechanism", "problem"), F.col("mechanism"), source)))
    own = settled(own.select("hyp_id", "roadmap", source.alias("__source"), "__g", "__c", "__e"))  # the wording's patterns run once: nodes, links and states read what they found
    enough = (F.size("__g.nodes") >= 2) & (F.size("__g.links") >= 1)
    part = lambda name, kind: F.concat(F.col(f"__g.{name}"), F.when(enough, F.array().cast(kind)).otherwise(F.col(f"__c.{name}")), F.coalesce(F.col(f"__e.{name}"), F.array().cast(kind)))
    nodes = own.select("hyp_id", "__source", F.posexplode(part("nodes", _NODE)).alias("at", "n")).select("hyp_id", "at", "n.id", "n.type", F.coalesce("n.source_doc_id", F.when(F.col("n.type").isin("Material", "Process", "Parameter", "Property") & (F.col("n.id") != GANGUE), F.col("__source"))).alias("source_doc_id"))
    nodes = distinct_nodes(nodes, clean=True)
    links = own.select("hyp_id", F.posexplode(part("links", _LINK)).alias("at", "k")).select("hyp_id", "at", "k.source", "k.target", "k.type")
    states = roadmap_states(own)
    nodes = settled(nodes)
    target = nodes.groupBy("hyp_id").agg(F.min_by("id", F.when(F.col("type") == "Property", F.col("at"))).alias("kpi"), F.max_by("id", "at").alias("last"))
    first = states.filter("at = 0").join(target, "hyp_id").select("hyp_id", F.lit(1 << 20).alias("at"), F.col("id").alias("source"), F.coalesce("kpi", "last").alias("target"), F.lit("VALIDATES").alias("type"))
    phases = states.select("hyp_id", (F.col("at") + (1 << 20)).alias("at"), "id", F.lit("State").alias("type"), F.lit(None).cast("string").alias("source_doc_id"))
    return distinct_nodes(nodes.unionByName(phases), clean=True), distinct_links(links.unionByName(first), clean=True), states


def _firsts(items: Column, *names: str) -> Column:
    """Of an array's structs that agree in these fields the first; a hypothesis's are few."""

    def same(x: Column, y: Column) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & x[n].eqNullSafe(y[n])
        return out

    return tx.let(items, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: same(x, y))))


def told_measures(hyps: DataFrame) -> DataFrame:
    """hyps with graph_measures() of whole_graph(), counted in each row; for n_sourced the nodes that name a source themselves (n_given)
    and those that take the hypothesis's first where it has one (n_own), so that hypotheses of one wording can share a row."""
    has = lambda c: F.col(c) if c in hyps.columns else F.lit(None).cast("string")
    own = F.lit("")  # stands for the hypothesis's first source; no supplied node has it
    graph = hyps.withColumns({"__g": supplied_graph(has("graph")), "__c": causal_graph(F.concat_ws(" ", "text", "mechanism", "problem"), F.col("mechanism"), own), "__s": states_array(F.coalesce("roadmap", F.array().cast("array<string>")))})
    graph = graph.withColumn("__e", F.when(F.coalesce(has("chunk_text"), F.lit("")) != "", causal_graph(F.concat_ws(" ", "text", has("chunk_text"), "mechanism", "problem"), F.col("mechanism"), own)))
    enough = (F.size("__g.nodes") >= 2) & (F.size("__g.links") >= 1)
    part = lambda name, kind: F.concat(F.col(f"__g.{name}"), F.when(enough, F.array().cast(kind)).otherwise(F.col(f"__c.{name}")), F.coalesce(F.col(f"__e.{name}"), F.array().cast(kind)))
    node = lambda n: F.struct(n["id"].alias("id"), F.lower(n["id"]).alias("k"), n["type"].alias("type"), n["source_doc_id"].alias("source"))
    state = lambda x: F.struct(x["id"].alias("id"), F.lower(x["id"]).alias("k"), F.lit("State").alias("type"), F.lit(None).cast("string").alias("source"))
    link = lambda a, b, kind: F.struct(F.lower(a).alias("s"), F.lower(b).alias("t"), kind.alias("type"))
    full = lambda nodes: F.filter(nodes, lambda n: n["id"] != "")
    graph = graph.withColumn("__n", _firsts(full(F.transform(part("nodes", _NODE), node)), "k"))
    kpi = F.get(F.filter("__n", lambda n: n["type"] == "Property"), 0)["id"]
    begins = F.when((F.size("__s") > 0) & (F.size("__n") > 0), F.array(link(F.get("__s", 0)["id"], F.coalesce(kpi, F.get("__n", F.size("__n") - 1)["id"]), F.lit("VALIDATES"))))
    links = F.concat(F.transform(part("links", _LINK), lambda k: link(k["source"], k["target"], k["type"])), F.coalesce(begins, F.array().cast("array<struct<s:string,t:string,type:string>>")))
    links = F.filter(links, lambda k: (k["s"] != k["t"]) & (k["s"] != "") & (k["t"] != ""))
    graph = graph.withColumns({"__k": _firsts(links, "s", "t", "type"), "__n": _firsts(F.concat("__n", full(F.transform("__s", state))), "k")})
    n = lambda cond: F.size(F.filter("__n", lambda x: F.coalesce(cond(x), F.lit(False)))).cast("long")
    takes = lambda x: (x["source"] == "") | (x["source"].isNull() & x["type"].isin("Material", "Process", "Parameter", "Property") & (x["id"] != GANGUE))
    counts = {
        "n_nodes": n(lambda x: F.lit(True)), "n_kpi": n(lambda x: x["type"].isin("Property", "KPI")), "n_property": n(lambda x: x["type"] == "Property"), "n_interventions": n(lambda x: x["type"].isin("Material", "Process", "Parameter")),
        "n_state_nodes": n(lambda x: x["type"] == "State"), "n_given": n(lambda x: x["source"] != ""), "n_own": n(takes), "n_links": F.size("__k").cast("long"), "n_states": F.size("__s").cast("long"),
    }
    return graph.select(*hyps.columns, *[c.alias(k) for k, c in counts.items()])


def roadmap_states(hyps: DataFrame, phases: Sequence[tuple[str, str, int]] = PHASES, most: int = 6) -> DataFrame:
    """(hyp_id, at, id, phase_order, from_id): a state for each of six steps, and the state before it."""
    # rows are dealt out as a file of few parts has many
    states = states_array(F.col("roadmap"), phases, most)
    return spread(hyps.select("hyp_id", "roadmap"), "hyp_id").select("hyp_id", F.explode(states).alias("s")).select("hyp_id", "s.at", "s.id", "s.phase_order", "s.from_id")


def states_array(roadmap: Column, phases: Sequence[tuple[str, str, int]] = PHASES, most: int = 6) -> Column:
    """H13 in a row: the states in order."""

    def state(step: Column, at: Column) -> Column:
        own = F.concat(F.lit("шаг "), (at + 1).cast("string"))
        label, order = own, at + 1
        for pattern, name, number in reversed(phases):
            hit = tx.matches(step, pattern)
            label, order = F.when(hit, F.lit(name)).otherwise(label), F.when(hit, F.lit(number) if number else at + 1).otherwise(order)
        again = tx.clean_id(F.concat(own, F.lit(": "), F.substring(step, 1, 35)))
        return F.struct(at.alias("at"), tx.clean_id(F.concat(label, F.lit(": "), F.substring(step, 1, 40))).alias("id"), again.alias("again"), order.alias("phase_order"))

    # the steps of a hypothesis are few and in its row: nothing is sorted
    told = lambda s: F.transform(s, lambda x, i: F.struct(x["at"].alias("at"), F.when(F.exists(F.slice(s, F.lit(1), i), lambda y: F.lower(y["id"]).eqNullSafe(F.lower(x["id"]))), x["again"]).otherwise(x["id"]).alias("id"), x["phase_order"].alias("phase_order")))
    linked = lambda s: F.transform(s, lambda x, i: F.struct(x["at"].alias("at"), x["id"].alias("id"), x["phase_order"].alias("phase_order"), F.get(s, i - 1)["id"].alias("from_id")))
    return tx.let(tx.let(F.transform(F.slice(roadmap, 1, most), state), told), linked)


def graph_measures(hyps: DataFrame, nodes: DataFrame, links: DataFrame, states: DataFrame) -> DataFrame:
    """Counts that validation and completeness rest on; hypotheses without a graph have zeros."""
    n = nodes.groupBy("hyp_id").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("type").isin("Property", "KPI")).alias("n_kpi"), F.count_if(F.col("type") == "Property").alias("n_property"),
        F.count_if(F.col("type").isin("Material", "Process", "Parameter")).alias("n_interventions"), F.count_if(F.col("type") == "State").alias("n_state_nodes"), F.count("source_doc_id").alias("n_sourced"),
    )
    k, s = links.groupBy("hyp_id").agg(F.count("*").alias("n_links")), states.groupBy("hyp_id").agg(F.count("*").alias("n_states"))
    out = hyps.select("hyp_id").join(n, "hyp_id", "left").join(k, "hyp_id", "left").join(s, "hyp_id", "left")
    return out.na.fill(0)


def validate(measures: DataFrame) -> DataFrame:
    """The issues of each graph in order; valid where none but a recommendation is left. n_sources of measures: the hypothesis's sources."""
    issue = lambda bad, text: F.when(bad, F.lit(text))
    found = F.array(
        issue(F.col("n_nodes") < 2, "Граф влияния: менее 2 узлов"),
        issue(F.col("n_links") < 1, "Граф влияния: нет связей между узлами"),
        issue(F.col("n_kpi") == 0, "Граф влияния: нет целевого KPI (Property)"),
        issue(F.col("n_interventions") == 0, "Граф влияния: нет узла вмешательства (Material/Process/Parameter)"),
        issue((F.col("n_sources") > 0) & (F.col("n_sourced") == 0), "Граф влияния: узлы не привязаны к source_doc_id"),
        issue(F.col("n_states") == 0, "Рекомендация: добавьте фазы roadmap в граф (states)"),
    )
    out = measures.withColumn("issues", F.filter(found, lambda x: x.isNotNull()))
    return out.withColumn("valid", F.size(F.filter("issues", lambda x: ~x.startswith("Рекомендация"))) == 0)


def completeness() -> object:
    """0 to 1, over graph_measures()."""
    part = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return F.least(
        F.lit(1.0),
        part(F.col("n_nodes") >= 3, 0.25) + part(F.col("n_links") >= 2, 0.2) + part(F.col("n_property") > 0, 0.15)
        + part((F.col("n_state_nodes") > 0) | (F.col("n_states") > 0), 0.2) + part(F.col("n_sourced") > 0, 0.2),
    )


def upsert_entities(entities: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """(label, name, properties) of entities (label, name, key, value, version): unknown labels become Parameter,
    and each property keeps its newest value."""
    known = F.when(F.col("label").isin(list(labels)), F.col("label")).otherwise(F.lit(FALLBACK_LABEL))
    e = entities.withColumn("label", known).filter(F.coalesce("name", F.lit("")) != "")
    newest = e.groupBy("label", "name", "key").agg(F.max_by("value", "version").alias("value"))
    return newest.groupBy("label", "name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties"))


def upsert_relations(relations: DataFrame, entities: DataFrame, kinds: Sequence[str] = RELATIONS) -> tuple[DataFrame, DataFrame]:
    """Relations (doc_id, source, target, type) of documents, once, each end with its entity's label (label, name; Parameter
    where it is none), unknown kinds as CORRELATES_WITH; and the edges from each document's publication to the entities that it names."""
    known = F.when(F.upper("type").isin(list(kinds)), F.upper("type")).otherwise(F.lit(FALLBACK_RELATION))
    r = relations.filter((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")).withColumn("type", known)
    label = entities.groupBy("name").agg(F.min("label").alias("label"))
    of = lambda side: label.select(F.col("name").alias(side), F.col("label").alias(f"{side}_label"))
    edges = r.select("source", "target", "type").distinct().join(of("source"), "source", "left").join(of("target"), "target", "left")
    edges = edges.select("source", F.coalesce("source_label", F.lit(FALLBACK_LABEL)).alias("source_label"), "target", F.coalesce("target_label", F.lit(FALLBACK_LABEL)).alias("target_label"), "type")
    named = r.select("doc_id", F.explode(F.array("source", "target")).alias("name")).distinct()
    return edges, named.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("publication"), "name", F.lit("CITED_BY").alias("type"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "Publication").alias("publications"))
    return n.join(edges.agg(F.count("*").alias("relationships")), F.lit(True))


def guess_label(names: DataFrame, entities: DataFrame) -> DataFrame:
    """The label of an entity of the same name, else by what the name says."""
    by_name = F.when(tx.matches(F.col("name"), "флотац|выщелач|измельч|процесс|process"), "Process").when(tx.matches(F.col("name"), "извлечени|recovery|выход|yield"), "Property").otherwise("Parameter")
    known = entities.select("name", "label").dropDuplicates(["name"])
    return names.join(known, "name", "left").withColumn("label", F.coalesce("label", by_name))


def merge_relations(parts: DataFrame, kinds: Sequence[str] = RELATIONS) -> DataFrame:
    """Relations (doc_id, origin, at, source, target, type) once whatever their ends' case; metadata (origin 0) first; no loops."""
    known = parts.withColumn("type", F.when(F.upper("type").isin(list(kinds)), F.upper("type")).otherwise(F.lit(FALLBACK_RELATION)))
    k = known.withColumns({"__s": F.lower(tx.strip(F.col("source"))), "__t": F.lower(tx.strip(F.col("target")))}).filter("__s <> __t AND __s <> '' AND __t <> ''")
    # dealt out by document first, so that rows are sorted once, behind that, and what counts by document deals nothing out again
    return ranked(spread(k, "doc_id"), ["doc_id", "__s", "__t", "type"], [F.asc("origin"), F.asc("at")], 1, "__n").drop("__n", "__s", "__t")


def merge_extracted(parts: DataFrame) -> DataFrame:
    """Entities (doc_id, origin, at, name, type) once whatever their case; metadata (origin 0) first."""
    return ranked(parts.withColumn("__k", F.lower("name")), ["doc_id", "__k"], [F.asc("origin"), F.asc("at")], 1, "__n").drop("__n", "__k")
