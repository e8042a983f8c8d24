"""Sheets as rows of cells: sheet_rows(workbook, sheet, row_idx, cells)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from .lineage import kept, spread
from .ranks import ranked_wide
from .retrieval import ranked

NUMERIC = r"^[\d.,eE+\-]+$"
GRAIN = r"(?i)^[+\-]?\d+(?:\s*\+\s*\d+)?(?:\s*мкм)?$"


def cell_text(value: Column) -> Column:
    """A double as a cell: whole numbers without a point, others with 4 significant digits."""
    digits = F.greatest(F.lit(0), F.lit(3) - F.floor(F.log10(F.abs(value)))).cast("int")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.4g", value), r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    return F.when(value.isNull(), "").when(F.abs(value - F.round(value)) < 1e-6, F.round(value).cast("long").cast("string")).otherwise(F.when(digits >= 0, short))


def trimmed(cells: Column) -> Column:
    """Without the empty cells at the end."""
    last = F.array_max(F.transform(cells, lambda c, i: F.when(tx.strip(c) != "", i + 1).otherwise(0)))
    return F.slice(cells, 1, F.coalesce(last, F.lit(0)))


def is_numeric(cell: Column) -> Column:
    return tx.strip(cell).rlike(NUMERIC)


def is_label(cell: Column) -> Column:
    """At least 2 characters with a letter, no number and no size class."""
    c = tx.strip(cell)
    return (F.length(c) >= 2) & ~c.rlike(NUMERIC) & ~c.rlike(GRAIN) & c.rlike("[а-яёa-zA-Z]")


def labels(cells: Column, most: int = 8) -> Column:
    """(at, label) of the labels among the first cells."""
    found = F.transform(F.slice(cells, 1, most), lambda c, i: F.struct(i.alias("at"), tx.strip(c).alias("label")))
    return F.filter(found, lambda x: is_label(x["label"]))


def numbers_after(cells: Column, at: Column, most: int = 6) -> Column:
    """Cells with a digit behind a place."""
    rest = F.transform(F.slice(cells, at + 2, F.greatest(F.size(cells), F.lit(1))), tx.strip)
    return F.slice(F.filter(rest, lambda c: c.rlike(r"\d")), 1, most)


def grain(cells: Column) -> Column:
    """(at, label) of the first size class; null if there is none."""
    found = F.transform(cells, lambda c, i: F.struct(i.alias("at"), tx.strip(c).alias("label")))
    return F.get(F.filter(found, lambda x: x["label"].rlike(GRAIN) | x["label"].rlike(r"^[+\-]\d")), 0)


def rule_of(cells: Column, rules: Sequence[tuple[str, str]] = lx.TABLE_RULES) -> Column:
    """(at, rule, label) of the first cell that a rule matches, by the first such rule."""
    any_rule = "|".join(f"(?:{p})" for p, _ in rules)

    def first(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, rule in reversed(rules):
            out = F.when(tx.matches(low, pattern), F.lit(rule)).otherwise(out)
        return F.when(tx.matches(low, any_rule), out)  # most cells match none: one search tells

    named = F.transform(cells, lambda c, i: tx.let(tx.strip(c), lambda label: F.struct(i.alias("at"), tx.let(F.lower(label), first).alias("rule"), label.alias("label"))))
    return F.get(F.filter(named, lambda x: x["rule"].isNotNull()), 0)


def header_rows(rows: DataFrame, scan: int = 25) -> DataFrame:
    """Per sheet the header's row_idx: most labels (2 points) against numbers (1), the first of equals; 0 if none has two labels."""
    cells = trimmed(F.col("cells"))
    n_labels, n_numbers = F.size(F.filter(cells, is_label)), F.size(F.filter(cells, is_numeric))
    score = F.when((F.size(cells) >= 2) & (n_labels >= 2) & (2 * n_labels - n_numbers > 0), 2 * n_labels - n_numbers)
    some = rows.filter(F.col("row_idx") < scan).withColumn("score", score)
    best = some.groupBy("workbook", "sheet").agg(F.max_by("row_idx", F.struct("score", -F.col("row_idx"))).alias("at"), F.max("score").alias("score"))
    return best.select("workbook", "sheet", F.when(F.col("score").isNotNull(), F.col("at")).otherwise(0).alias("header_idx"))


def kpi_summary(rows: DataFrame, rules: Sequence[tuple[str, str]] = lx.TABLE_RULES, most_grains: int = 10) -> DataFrame:
    """The KPI lines of each sheet in order (workbook, sheet, at, line).

    A row's rule counts first. Size classes count between their header and a total row; that state is the last
    header or total row before, found by a window in row order. Recoverable share and tonnage keep the last value.
    """
    keys = ["workbook", "sheet"]
    r = rows.filter(F.size(trimmed(F.col("cells"))) > 0)
    return _with_lines(r, keys, ["row_idx"], F.col("row_idx"), rules, most_grains).filter("line IS NOT NULL").select(*keys, "at", "line")


def workbook_kpi_summary(rows: DataFrame, rules: Sequence[tuple[str, str]] = lx.TABLE_RULES, most_grains: int = 10) -> DataFrame:
    """K09 of workbook_rows(), as (workbook, at, line): rows are numbered where they are sorted."""
    return _with_lines(rows, ["workbook"], ["sheet", "row_idx"], F.col("__n") - 1, rules, most_grains).filter("line IS NOT NULL").select("workbook", "at", "line")


def _with_lines(rows: DataFrame, keys: Sequence[str], order: Sequence[str], row_idx: Column, rules: Sequence[tuple[str, str]], most_grains: int, keep: Sequence[str] = ()) -> DataFrame:
    """rows (keys, order, `keep`) with their number among those of their keys (__n) and the KPI line that stands at each (at, line), null
    for most. What a line needs of a row is read before rows are sorted, once."""
    cells = trimmed(F.col("cells"))
    r = rows.select(*dict.fromkeys([*keys, *order, *keep]), cells.alias("__c")).withColumns({"__r": rule_of(F.col("__c"), rules), "__g": grain(F.col("__c"))})
    totals = F.exists(F.transform(F.slice(labels(F.col("__c"), 3), 1, 3), lambda x: F.lower(x["label"])), lambda s: s.startswith("итого") | s.contains("раскрыт"))
    event = F.when(F.col("__r.rule") == "grain_header", 1).when(F.col("__r").isNull() & F.col("__g").isNull() & totals, 0)
    values = F.when(F.col("__r").isNotNull() | F.col("__g").isNotNull(), numbers_after(F.col("__c"), F.coalesce("__r.at", "__g.at"), 2))
    r = r.withColumns({"__event": event, "__values": values})
    r = r.select(*[c for c in r.columns if c not in ("__c", "__r", "__g", "__values")], F.col("__r.rule").alias("__rule"), F.coalesce("__r.label", "__g.label").alias("__label"), F.get("__values", 0).alias("__first"), F.get("__values", 1).alias("__second"))
    r = spread(r, *keys)
    all_, sorted_ = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order)
    before = sorted_.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({"__n": F.row_number().over(sorted_), "__inside": F.coalesce(F.last("__event", ignorenulls=True).over(before), F.lit(0)) == 1})
    # a rule's name without a number says nothing; a size class may lack both numbers
    r = r.withColumn("__kind", F.when(F.col("__rule").isNotNull(), F.when(F.col("__first").isNotNull() & (F.col("__rule") != "grain_header"), F.col("__rule"))).when(F.col("__label").isNotNull() & F.col("__inside"), "size class"))
    is_ = lambda kind: F.col("__kind") == kind
    last = lambda kind: is_(kind) & (F.col("__n") == F.max(F.when(is_(kind), F.col("__n"))).over(all_))
    sizes = F.coalesce(F.count_if(is_("size class")).over(before), F.lit(0))
    r = r.withColumns({"__share": last("recoverable"), "__tons": last("tailings"), "__sizes": sizes})
    shown = F.when(F.lower("__label").contains("мкм"), F.col("__label")).otherwise(F.concat("__label", F.lit(" мкм")))
    line = (
        F.when(F.col("__share"), F.concat(F.lit("- Итого извлекаемый металл в хвостах: "), "__first", F.lit("%")))
        .when(F.col("__tons"), F.concat(F.lit("- Отвальные хвосты: "), "__first", F.lit(" т")))
        .when(is_("size class"), F.when(F.col("__sizes") < most_grains, F.concat(F.lit("- "), shown, F.lit(": доля класса "), F.coalesce("__first", F.lit("")), F.lit("%, метрика "), F.coalesce("__second", F.lit("")))))
        .when(~F.col("__kind").isin("recoverable", "tailings"), F.concat(F.lit("- "), "__label", F.lit(": "), "__first"))
    )
    at = F.when(F.col("__share"), F.lit(-2)).when(F.col("__tons"), F.lit(-1)).otherwise(row_idx.cast("long") + F.when(is_("size class"), F.lit(1 << 40)).otherwise(F.lit(0)))
    return r.withColumns({"at": at.cast("long"), "line": line})


def sheet_overview(rows: DataFrame) -> DataFrame:
    """Per sheet rows, columns, up to 8 header cells and up to 5 samples "label: values" behind the header."""
    keys = ["workbook", "sheet"]
    r = rows.withColumn("cells", trimmed(F.col("cells"))).filter(F.size("cells") > 0)
    r = r.withColumn("row_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx")) - 1)
    head = header_rows(r)
    sized = r.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_columns"))
    top = r.join(head, keys).filter("row_idx = header_idx").select(*keys, F.slice(F.filter("cells", lambda c: tx.strip(c) != ""), 1, 8).alias("columns"))
    first = F.get(labels(F.col("cells"), 4), 0)
    body = r.join(head, keys).filter("row_idx > header_idx").withColumn("first", first).filter("first IS NOT NULL").withColumn("values", numbers_after(F.col("cells"), F.col("first.at"), 4)).filter(F.size("values") > 0)
    samples = ranked(body, keys, [F.asc("row_idx")], 5, "n").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", F.concat("first.label", F.lit(": "), F.array_join("values", ", ")).alias("s")))).alias("s"))
    return sized.join(top, keys, "left").join(samples.select(*keys, F.col("s.s").alias("samples")), keys, "left")


def workbook_rows(rows: DataFrame) -> DataFrame:
    """Rows of all sheets of a workbook as one sheet "", sheets by name: what its KPIs are read from."""
    at = F.row_number().over(Window.partitionBy("workbook").orderBy("sheet", "row_idx")) - 1
    return rows.select("workbook", F.lit("").alias("sheet"), at.alias("row_idx"), "cells")


def overview_lines(overview: DataFrame) -> DataFrame:
    """K10 as text: (workbook, sheet, at, line)."""
    head = F.concat(F.lit("- Лист «"), "sheet", F.lit("»: "), F.col("n_rows").cast("string"), F.lit(" строк × "), F.col("n_columns").cast("string"), F.lit(" колонок"))
    columns = F.when(F.size("columns") > 0, F.concat(F.lit("  Колонки: "), F.array_join("columns", ", ")))
    samples = F.transform(F.coalesce("samples", F.array().cast("array<string>")), lambda s: F.concat(F.lit("  · "), s))
    lines = F.filter(F.concat(F.array(head, columns), samples), lambda x: x.isNotNull())
    return overview.select("workbook", "sheet", F.posexplode(lines).alias("at", "line"))


def workbook_summary(rows: DataFrame) -> DataFrame:
    """(workbook, part, sheet, at, line) in order: the file, then its KPIs, or else an overview of each sheet. Rows are sorted
    once; of workbooks with KPIs no more than the lines is kept."""
    r = _with_lines(rows, ["workbook"], ["sheet", "row_idx"], F.col("__n") - 1, lx.TABLE_RULES, 10, ["cells"])
    all_, sorted_ = Window.partitionBy("workbook"), Window.partitionBy("workbook").orderBy("sheet", "row_idx")
    r = r.withColumns({"__known": F.max(F.col("line").isNotNull()).over(all_), "__new": F.col("sheet").isNotNull() & ~F.coalesce(F.lag("sheet").over(sorted_) == F.col("sheet"), F.lit(False))})
    r = r.withColumn("__sheets", F.count_if("__new").over(all_))
    told = lambda part, at, line: F.struct(F.lit(part).alias("part"), at.cast("long").alias("at"), line.alias("line"))
    first = F.col("__n") == 1
    lines = F.array(
        F.when(first, told(0, F.lit(0), F.concat(F.lit("- Файл: "), "workbook", F.lit(", листов: "), F.col("__sheets").cast("string")))),
        F.when(first, told(0, F.lit(1), F.when(F.col("__known"), "## Сводка KPI").otherwise("## Обзор листов"))),
        F.when(F.col("line").isNotNull(), told(1, F.col("at"), F.col("line"))),
    )
    r = r.select("workbook", "sheet", "row_idx", F.when(~F.col("__known"), F.col("cells")).alias("cells"), F.filter(lines, lambda x: x.isNotNull()).alias("lines"))
    r = kept(r.filter("size(lines) > 0 OR cells IS NOT NULL"), "workbooks")
    rest = overview_lines(sheet_overview(r.filter("cells IS NOT NULL").drop("lines")))
    heads = r.select("workbook", F.explode("lines").alias("x")).select("workbook", "x.part", F.lit("").alias("sheet"), "x.at", "x.line")
    return heads.union(rest.select("workbook", F.lit(1), "sheet", F.col("at").cast("long"), "line"))


def workbook_kpis(summary: DataFrame) -> DataFrame:
    """Per workbook tailings_tonnage (string), recoverable_pct and the size classes in order, from the lines of kpi_summary()."""
    line = F.col("line")
    tonnage = F.replace(F.nullif(F.regexp_extract("line", r":\s*([\d.,eE+-]+)", 1), F.lit("")), F.lit(","), F.lit("."))
    share = F.replace(F.nullif(F.regexp_extract("line", r":\s*([\d.,]+)\s*%", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    size = F.nullif(tx.strip(F.regexp_extract("line", r"(?i)^-\s*([+\-]?\d+(?:\s*\+\s*\d+)?(?:\s*мкм)?)", 1)), F.lit(""))
    s = summary.withColumns({"tonnage": F.when(line.contains("Отвальные хвосты"), tonnage), "share": F.when(F.lower(line).contains("извлекаемый металл"), share), "size": size})
    sizes = F.transform(F.sort_array(F.collect_list(F.when(F.col("size").isNotNull(), F.struct("at", "size")))), lambda x: x["size"])
    return s.groupBy("workbook").agg(F.max("tonnage").alias("tailings_tonnage"), F.max("share").alias("recoverable_pct"), sizes.alias("grain_classes"))


def priority_chunks(summary: DataFrame) -> DataFrame:
    """(workbook, text): a short chunk of a workbook's KPI lines (some tens at most), to be put before its other chunks."""
    lines = summary.groupBy("workbook").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("lines"))
    return lines.select("workbook", kpi_chunk(F.col("workbook"), F.col("lines")).alias("text"))


def kpi_chunk(name: Column, lines: Column) -> Column:
    head = F.concat(F.lit("# KPI-сводка: "), name)
    return F.concat_ws("\n", head, F.lit("Тег: enterprise_kpi — цитируй этот блок для KPI из Excel (%, тоннаж, крупность)."), F.lit(""), lines)


def with_priority(chunks: DataFrame, first: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, text) with a document's priority chunk (doc_id, text) as number 0 and the others behind it."""
    first = kept(first.select("doc_id", "text"), "first")  # read twice
    some = first.select("doc_id", F.lit(1).alias("__shift")).distinct()
    moved = chunks.select("doc_id", "chunk_index", "text").join(some, "doc_id", "left").withColumn("chunk_index", F.col("chunk_index") + F.coalesce("__shift", F.lit(0)))
    return first.select("doc_id", F.lit(0).alias("chunk_index"), "text").union(moved.select("doc_id", "chunk_index", "text"))


def recovered_summary(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the KPI chunk of a processed document (doc_id, title, text), from the table rows in its text, or
    else from the one figure that a pattern finds; documents with neither have none."""
    key = F.col("doc_id").cast("string")
    rows = text_rows(docs).select(key.alias("workbook"), F.lit("").alias("sheet"), "row_idx", "cells")
    lines = kpi_summary(rows).groupBy(F.col("workbook").alias("__k")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("lines"))
    share = F.replace(F.nullif(F.regexp_extract("text", r"(?iU)итого\s+извлекаем\w*\s+металл[^|]{0,80}\|\s*([\d.,]+)", 1), F.lit("")), F.lit(","), F.lit("."))
    found = F.coalesce("lines", F.concat(F.lit("- Итого извлекаемый металл в хвостах: "), share, F.lit("%")))
    joined = docs.join(lines, key == F.col("__k"), "left").withColumn("__found", found).filter("__found IS NOT NULL")
    return joined.select("doc_id", kpi_chunk(F.coalesce("title", F.lit("KPI.xlsx")), F.col("__found")).alias("text"))


def rows_text(rows: DataFrame) -> DataFrame:
    """A sheet's rows as text, cells joined by " | "."""
    r = rows.withColumn("cells", trimmed(F.col("cells"))).filter(F.size("cells") > 0).withColumn("line", F.array_join("cells", " | "))
    lines = r.groupBy("workbook", "sheet").agg(F.sort_array(F.collect_list(F.struct("row_idx", "line"))).alias("x"))
    return lines.select("workbook", "sheet", F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n"), F.array_join("x.line", "\n")).alias("text"))


def text_rows(docs: DataFrame) -> DataFrame:
    """The lines of a text that hold a bar, as rows of cells."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("row_idx", "line")).filter(F.col("line").contains("|"))
    cells = F.transform(F.split("line", r"\|", -1), tx.strip)
    return lines.select("doc_id", "row_idx", cells.alias("cells")).filter(F.exists("cells", lambda c: c != ""))


def canonical_field(header: Column, rules: Sequence[tuple[str, Sequence[str]]] = lx.HEADER_RULES) -> Column:
    """The field that a header names, by the first rule."""
    h, out = F.translate(F.lower(tx.strip(header)), " -", "__"), F.lit(None).cast("string")
    for field, parts in reversed(rules):
        out = F.when(tx.contains_any(h, parts), F.lit(field)).otherwise(out)
    return out


def experiment_columns(rows: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = lx.HEADER_RULES) -> DataFrame:
    """Per sheet (header_idx, field, at): the columns of the first of 15 rows with two factors and the target."""
    keys = ["workbook", "sheet"]
    cells = rows.filter("row_idx < 15").select(*keys, "row_idx", F.posexplode("cells").alias("at", "cell")).withColumn("field", canonical_field(F.col("cell"), rules)).filter("field IS NOT NULL")
    fields = cells.groupBy(*keys, "row_idx", "field").agg(F.min("at").alias("at"))
    test = fields.groupBy(*keys, "row_idx").agg(F.count_if(F.col("field").isin("pH", "reagent_dosage", "temperature_C")).alias("factors"), F.max(F.col("field") == "recovery_pct").alias("target"))
    head = test.filter("factors >= 2 AND target").groupBy(*keys).agg(F.min("row_idx").alias("row_idx"))
    return fields.join(head, [*keys, "row_idx"]).withColumnRenamed("row_idx", "header_idx")


def experiment_rows(rows: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = lx.HEADER_RULES, most: int = 500) -> DataFrame:
    """A row for each experiment with a numeric target; the default id counts the experiments."""
    keys = ["workbook", "sheet"]
    fields = experiment_columns(rows, rules)
    places = fields.groupBy(*keys, "header_idx").agg(F.map_from_entries(F.collect_list(F.struct("field", "at"))).alias("__at"))  # a row a sheet
    cell = lambda f: F.get("cells", F.try_element_at("__at", F.lit(f)))
    value = lambda f: tx.parse_number(cell(f)).alias(f)
    numbers = ("pH", "reagent_dosage", "temperature_C", "recovery_pct")
    long = rows.filter(F.col("row_idx") < most).join(places, keys).filter("row_idx > header_idx")
    long = long.select(*keys, "row_idx", F.nullif(tx.strip(cell("sample_id")), F.lit("")).alias("sample_id"), *[value(f) for f in numbers])
    wide = spread(long, *keys, "row_idx").groupBy(*keys, "row_idx").agg(*[F.max(c).alias(c) for c in ("sample_id", *numbers)]).filter("recovery_pct IS NOT NULL")
    numbered = ranked_wide(wide, keys, [F.asc("row_idx")], "n")  # a sheet may be long: no task holds it whole
    return numbered.withColumn("sample_id", F.coalesce("sample_id", F.concat(F.lit("row_"), "n"))).drop("n")


def experiment_text(name: Column) -> Column:
    """An experiment as text; fields without a value are left out."""
    line = lambda label, c, unit: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"), F.lit(unit)))
    head = F.concat(F.lit("# Лабораторный опыт "), F.coalesce("sample_id", F.lit("?")), F.lit(" ("), name, F.lit(")"))
    return F.concat_ws("\n", head, line("pH", "pH", ""), line("Дозировка реагента", "reagent_dosage", " кг/т"), line("Температура", "temperature_C", " °C"), line("Извлечение", "recovery_pct", "%"))


FACTORS = ("pH", "reagent_dosage", "temperature_C")


def experiment_metadata(file: Column, stem: Column) -> Column:
    """An experiment's source `file#sample`, title, tags, factors, result, and its record for a laboratory archive."""
    sample = F.coalesce("sample_id", F.lit("row"))
    factors = F.map_filter(F.create_map(*[x for f in FACTORS for x in (F.lit(f), F.col(f).cast("double"))]), lambda k, v: v.isNotNull())
    lab = F.struct(
        stem.alias("investigation_id"), F.concat(stem, F.lit("_study")).alias("study_id"), F.concat(stem, F.lit("_"), sample).alias("assay_id"), F.map_keys(factors).alias("factor_names"),
        factors.alias("factor_values"), F.lit("recovery_pct").alias("measurement_type"), F.col("recovery_pct").cast("string").alias("measurement_value"), F.lit("%").alias("unit"),
    )
    return F.struct(
        F.concat(file, F.lit("#"), sample).alias("source"), F.concat(stem, F.lit(" / "), sample).alias("title"), sample.alias("sample_id"), F.lit("лабораторный опыт").alias("material"),
        F.array(*[F.lit(x) for x in ("structured_experiment", "experiment_row", "xlsx_type:lab_experiments")]).alias("tags"), factors.alias("process_parameters"),
        F.create_map(F.lit("recovery_pct"), F.col("recovery_pct").cast("double")).alias("measurement_results"), lab.alias("lab_record"),
        F.concat(F.lit("allotrope:process/flotation/"), stem, F.lit("-laboratory-assay")).alias("process_uri"),
    )


def experiment_documents(rows: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """A document (doc_id, workbook, text, metadata) for each experiment of the sheets, and per workbook the totals (n_documents, n_experiments)."""
    stem = F.regexp_replace("workbook", r"\.[^.]*$", "")
    e = experiment_rows(rows, most=most)
    docs = e.select(experiment_id(stem).alias("doc_id"), "workbook", experiment_text(F.col("workbook")).alias("text"), experiment_metadata(F.col("workbook"), stem).alias("metadata"))
    return docs.dropDuplicates(["doc_id"]), docs.groupBy("workbook").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_experiments"))


def experiment_id(stem: Column) -> Column:
    """Stem, safe sample name and a digest of the five fields."""
    fields = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in ("sample_id", "pH", "reagent_dosage", "temperature_C", "recovery_pct")])
    safe = F.substring(F.regexp_replace("sample_id", r"(?U)[^\w\-]+", "_"), 1, 24)
    return F.concat(stem, F.lit("_"), safe, F.lit("_"), F.substring(F.sha2(F.encode(fields, "UTF-8"), 256), 1, 8))
