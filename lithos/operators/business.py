"""Business cases and roadmaps. steps: hyp_id, step_order, title, duration_days, resources, depends_on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.functions import text as tx

# Patterns of stated effects, in percent, and of baselines in contexts.
DELTA = (
    r"(?:увелич\w*|повыс\w*|улучш\w*|сниз\w*|increase|improve|reduce)\w*[^.\n]{0,40}?на\s+(\d+(?:[.,]\d+)?)\s*%",
    r"прирост\w*\s*(\d+(?:[.,]\d+)?)\s*%",
    r"Δ\s*(\d+(?:[.,]\d+)?)\s*%",
    r"by\s+(\d+(?:[.,]\d+)?)\s*%",
)
BASELINE = (
    r"извлечени\w*\s*[:=]?\s*(\d+(?:[.,]\d+)?)\s*%",
    r"recovery\s*[:=]?\s*(\d+(?:[.,]\d+)?)",
    r"strength\s*[:=]?\s*(\d+(?:[.,]\d+)?)",
    r"yield\s*[:=]?\s*(\d+(?:[.,]\d+)?)",
    r"efficien\w*\s*[:=]?\s*(\d+(?:[.,]\d+)?)\s*%?",
)

# Resources that a step names, those where it names none, failure where it states none, and step templates.
RESOURCES = (r"(\d+(?:[.,]\d+)?\s*(?:кг|г)\s*/?\s*т\s+\w+)", r"(лаборатор\w+\s+\w+)", r"(флотомашин\w+|ячейк\w+)", r"(проб[аы]\s+\d+)", r"(реагент\w+)")
DEFAULT_RESOURCES = ("пробы 1 кг", "существующее лабораторное оборудование")
DEFAULT_SUCCESS = "Улучшение целевого KPI ≥3% относительно контроля"
DEFAULT_FAILURE = "Отсутствие статистически значимого эффекта vs контроль"
TEMPLATES = (
    ("lab_baseline", "Контрольный опыт на пробах 1 кг", 7, ("пробы 1 кг", "лабораторная флотомашина", "реагенты базового режима")),
    ("reagent_sweep", "Серия опытов с варьированием дозировки", 14, ("пробы 3×1 кг", "реагент", "анализ проб")),
    ("ph_matrix", "Оптимизация pH в заданном диапазоне", 10, ("пробы 2 кг", "pH-метр", "реагенты регулировки pH")),
    ("pilot_cell", "Пилотные испытания на промышленной ячейке", 21, ("проба 50 кг", "пилотная ячейка", "оператор смены")),
    ("analytics", "Химический и granulometric анализ", 5, ("10 проб", "ICP/AAS", "гранулометрия")),
)


def expected_delta(text: Column, expected_value: Column, predicted: Column | None = None) -> Column:
    """The model's value within [-5, 15], else the first stated effect of at most 15, else from the value score."""
    rest = F.coalesce(stated_delta(text), F.when(expected_value >= 7, F.round(2.0 + (expected_value - 7) * 1.5, 1)))
    return rest if predicted is None else F.when(predicted.isNotNull(), F.round(F.greatest(F.lit(-5.0), F.least(F.lit(15.0), predicted)), 2)).otherwise(rest)


def stated_delta(text: Column) -> Column:
    """The first stated effect of at most 15."""
    return F.coalesce(*[F.when(s <= 15, s) for s in (tx.first_number(text, p) for p in DELTA)])


def baseline(hits: DataFrame) -> DataFrame:
    """Per query the mean of all KPI numbers in its hits, and how many there are."""
    numbers = F.concat(*[tx.all_of(F.col("text"), f"(?iU){p}", 1) for p in BASELINE])
    values = hits.select("query_id", F.explode(numbers).alias("v")).withColumn("v", F.replace("v", F.lit(","), F.lit(".")).cast("double"))
    return values.groupBy("query_id").agg(F.avg("v").alias("baseline"), F.count("*").alias("n"))


def economics(delta: Column, feasibility: Column, kpi: Column, no_capex: Column) -> Column:
    """(revenue, savings, capex, payback_months, roi) a year; null without a positive effect."""
    scale = F.when(tx.matches(kpi, "извлечени|recovery|yield|металл"), 1.0).when(tx.matches(kpi, "себестоим|cost"), 0.7).otherwise(0.5)
    benefit = 2_000_000.0 * scale * (delta / 3.0)
    capex = F.when(no_capex, 150_000.0).otherwise(800_000.0)
    opex = capex * 0.2 + (10 - feasibility) * 30_000
    out = F.struct((benefit * 0.75).alias("revenue"), (benefit * 0.25).alias("savings"), capex.alias("capex"), (capex / benefit * 12).alias("payback_months"), ((benefit - opex) / capex).alias("roi"))
    return F.when(delta > 0, out)


def business_case(hyps: DataFrame, problem: Column, no_capex: Column, n_sources: Column) -> DataFrame:
    """Target KPI, effect, economics, confidence and narrative of each hypothesis. A column baseline of hyps goes into the narrative."""
    return with_business_case(hyps.withColumns({"target_kpi": tx.kpi_label(problem), "delta_pct": expected_delta(F.concat_ws(" ", "text", "reasoning"), F.col("expected_value"))}), problem, no_capex, n_sources).select("hyp_id", "business_case.*")


def with_business_case(h: DataFrame, problem: Column, no_capex: Column, n_sources: Column) -> DataFrame:
    """business_case, a struct, of hypotheses that have target_kpi and delta_pct."""
    own = h.columns
    h = h.withColumn("e", economics(F.col("delta_pct"), F.col("feasibility"), F.col("target_kpi"), no_capex))
    confidence = F.when(F.col("e").isNull(), "low").when(n_sources >= 2, "high").otherwise("medium")
    base = F.col("baseline").cast("string") if "baseline" in own else F.lit(None).cast("string")
    h = h.withColumn("narrative", narrative(F.col("target_kpi"), problem, base, F.col("delta_pct"), F.col("e"), F.col("expected_value"), F.col("feasibility")))
    case = F.struct("target_kpi", "delta_pct", "narrative", F.round("e.revenue").alias("revenue"), F.round("e.savings").alias("savings"), F.col("e.capex").alias("capex"), F.round("e.payback_months", 1).alias("payback_months"), F.round("e.roi", 2).alias("roi"), confidence.alias("confidence"))
    return h.withColumn("business_case", case).select(*own, "business_case")


def narrative(kpi: Column, problem: Column, baseline: Column, delta: Column, e: Column, value: Column, feasibility: Column) -> Column:
    """The business case in words; what is not known is left out. e: economics()."""
    money = lambda c: F.format_number(F.round(c), 0)
    return F.concat_ws(
        " ",
        F.concat(F.lit("Целевой KPI: **"), kpi, F.lit("** по задаче «"), F.substring(problem, 1, 80), F.lit("».")),
        F.concat(F.lit("Базовый уровень по архиву: "), baseline, F.lit(".")),
        F.when(delta.isNotNull(), F.concat(F.lit("Ожидаемый прирост: **+"), F.format_string("%.1f", delta.cast("double")), F.lit(" п.п.**"))),
        F.concat(F.lit("Оценка экономического эффекта: **"), money(e["revenue"]), F.lit(" руб/год** (выручка/эффект); экономия: **"), money(e["savings"]), F.lit(" руб/год**.")),
        F.concat(F.lit("Окупаемость ~**"), money(e["payback_months"]), F.lit(" мес.**, ROI **"), F.format_string("%.1f", e["roi"]), F.lit("x** (лабораторный TRL, без капвложений — по ограничениям).")),
        F.concat(F.lit("Оценка ценности LLM: "), F.format_string("%s", value), F.lit("/10; реализуемость: "), F.format_string("%s", feasibility), F.lit("/10.")),
    )


def step_duration(text: Column, default: Column) -> Column:
    """Days (weeks times 7), 1 to 90."""
    n = F.regexp_extract(text, r"(?iU)(\d+)\s*(?:дн|день|дней|week|нед)", 1)
    weeks = F.when(tx.contains_any(F.lower(text), ("нед", "week")), 7).otherwise(1)
    return F.when(n != "", F.greatest(F.lit(1), F.least(n.try_cast("int") * weeks, F.lit(90)))).otherwise(default)


def described(raw: Column) -> Column:
    return tx.strip(F.regexp_replace(F.regexp_replace(tx.strip(raw), r"(?iU)^(step|шаг)\s*\d+\s*:\s*", ""), r"\s+", " "))


def step_title(description: Column, order: Column) -> Column:
    return F.when(F.length(description) > 20, F.substring(description, 1, 80)).otherwise(F.concat(F.lit("Шаг "), order.cast("string"), F.lit(": проверка гипотезы")))


def structured_roadmap(hyps: DataFrame) -> DataFrame:
    """The steps of hyps (hyp_id, text, roadmap); two default steps where there is no roadmap."""
    default = F.array(F.concat(F.lit("Лабораторная проверка: "), F.substring("text", 1, 100)), F.lit("Сравнение с контрольным режимом на существующем оборудовании"))
    steps = hyps.select("hyp_id", F.posexplode(F.when(F.size("roadmap") > 0, F.col("roadmap")).otherwise(default)).alias("at", "raw"))
    order = F.col("at") + 1
    s = steps.withColumns({"step_order": order, "description": described(F.col("raw"))})
    title = step_title(F.col("description"), order)
    success = F.regexp_extract("description", r"(?iU)успех\s*[-–:]\s*([^.]+)", 1)
    failure = F.regexp_extract("description", r"(?iU)провал\s*[-–:]\s*([^.]+)", 1)
    named = F.slice(F.array_distinct(F.transform(F.concat(*[tx.all_of(F.col("description"), f"(?iU){p}", 1) for p in RESOURCES]), tx.strip)), 1, 5)
    return s.select(
        "hyp_id", "step_order", title.alias("title"), "description", step_duration(F.col("description"), F.when(order == 1, 7).otherwise(14)).alias("duration_days"),
        F.substring(F.when(success != "", tx.strip(success)).otherwise(F.lit(DEFAULT_SUCCESS)), 1, 200).alias("success_criteria"),
        F.substring(F.when(failure != "", tx.strip(failure)).otherwise(F.lit(DEFAULT_FAILURE)), 1, 200).alias("failure_criteria"),
        F.when(F.size(named) > 0, named).otherwise(F.array(*[F.lit(r) for r in DEFAULT_RESOURCES])).alias("resources"),
        F.when(order > 1, F.array(order - 1)).otherwise(F.array().cast("array<int>")).alias("depends_on"),
    )


def timeline(steps: DataFrame) -> DataFrame:
    """start_day and end_day by running sums in step order."""
    before = Window.partitionBy("hyp_id").orderBy("step_order").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("duration_days").over(before), F.lit(0))
    return steps.withColumn("start_day", start).withColumn("end_day", F.col("start_day") + F.col("duration_days"))


def step_cost(days: Column, n_resources: Column) -> Column:
    """B13."""
    return 15_000 * F.greatest(F.lit(1), F.floor(days / 7)) + 8_000 * n_resources


def roadmap_summary(steps: DataFrame) -> DataFrame:
    """Days, steps, cost, entry points and resources (each once, in order of first use) of each hypothesis."""
    s = steps.withColumn("cost", step_cost(F.col("duration_days"), F.size("resources")))
    totals = s.groupBy("hyp_id").agg(F.sum("duration_days").alias("total_days"), F.count("*").alias("step_count"), F.sum("cost").alias("estimated_cost"), F.count_if(F.size("depends_on") == 0).alias("entry_points"))
    used = s.select("hyp_id", "step_order", F.posexplode("resources").alias("at", "r")).groupBy("hyp_id", "r").agg(F.min(F.struct("step_order", "at")).alias("first"))
    names = used.groupBy("hyp_id").agg(F.sort_array(F.collect_list(F.struct("first", "r")))["r"].alias("resources_unique"))
    return totals.join(names, "hyp_id", "left")


def roadmap_lines(steps: DataFrame) -> DataFrame:
    """A line for each step."""
    line = F.format_string("Шаг %d: %s (%d дн.)", F.col("step_order").cast("int"), "title", F.col("duration_days").cast("int"))
    return steps.select("hyp_id", "step_order", line.alias("line"))


def roadmap_told(text: Column, roadmap: Column) -> Column:
    """B09 to B11 in a row: the lines of structured_roadmap()."""
    default = F.array(F.concat(F.lit("Лабораторная проверка: "), F.substring(text, 1, 100)), F.lit("Сравнение с контрольным режимом на существующем оборудовании"))

    def line(raw: Column, at: Column) -> Column:
        return tx.let(described(raw), lambda d: F.format_string("Шаг %d: %s (%d дн.)", (at + 1).cast("int"), step_title(d, at + 1), step_duration(d, F.when(at == 0, 7).otherwise(14)).cast("int")))

    return F.transform(F.when(F.size(roadmap) > 0, roadmap).otherwise(default), line)


def template_steps(wanted: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Steps of wanted (hyp_id, step_order, template): those of known templates."""
    rows = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.struct(F.lit(title).alias("title"), F.lit(days).alias("days"), F.array(*[F.lit(r) for r in resources]).alias("resources"))) for k, title, days, resources in templates]))
    found = wanted.withColumn("t", F.try_element_at(rows, F.col("template"))).filter("t IS NOT NULL")
    return found.select(
        "hyp_id", "step_order", "t.title", F.col("t.title").alias("description"), F.col("t.days").alias("duration_days"), "t.resources", F.lit(DEFAULT_SUCCESS).alias("success_criteria"), F.lit(DEFAULT_FAILURE).alias("failure_criteria"),
        F.when(F.col("step_order") > 1, F.array(F.col("step_order") - 1)).otherwise(F.array().cast("array<int>")).alias("depends_on"),
    )


def reorder(steps: DataFrame, orders: DataFrame) -> DataFrame:
    """Steps in the order of orders (hyp_id, new_order ARRAY): numbers are places in that list, so that unknown ones leave holes."""
    o = orders.select("hyp_id", F.posexplode("new_order").alias("at", "step_order"))
    out = steps.join(o, ["hyp_id", "step_order"]).withColumn("step_order", F.col("at") + 1).drop("at")
    return out.withColumn("depends_on", F.when(F.col("step_order") > 1, F.array(F.col("step_order") - 1)).otherwise(F.array().cast("array<int>")))


def uncertainty(runs: DataFrame) -> DataFrame:
    """Per run the mean predictive and judge scores, counts of confidence levels and the commonest one. runs: run_id, predictive, overall_score, confidence."""
    levels = runs.groupBy("run_id", "confidence").count()
    top = levels.groupBy("run_id").agg(F.max_by("confidence", F.struct("count", "confidence")).alias("dominant"))
    return runs.groupBy("run_id").agg(F.avg("predictive").alias("predictive"), F.avg("overall_score").alias("judge"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("low", "medium", "high")]).join(top, "run_id")
