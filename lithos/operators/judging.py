"""Scores, checks, verdicts and run indexes of hypotheses.

hypotheses: hyp_id, run_id, text, mechanism, reasoning, novelty, feasibility, expected_value, risk_technical, risk_economic,
sources ARRAY<STRUCT<doc_id, snippet>>, roadmap ARRAY<STRING>. Scores are 0 to 10.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

from .lineage import settled
from .ranks import ranked_wide


def unit(value: Column, top: float = 10.0) -> Column:
    """J01. Null stays null (greatest and least would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(value / top, F.lit(1.0))))


def criteria(vector_novelty: Column | None = None) -> dict[str, Column]:
    stated = unit(F.col("novelty"))
    novelty = stated if vector_novelty is None else F.when(vector_novelty.isNotNull(), 0.6 * F.least(vector_novelty, F.lit(1.0)) + 0.4 * stated).otherwise(stated)
    risk = unit(10.0 - (F.col("risk_technical") + F.col("risk_economic")) / 2)
    return {"novelty": novelty, "feasibility": unit(F.col("feasibility")), "expected_value": unit(F.col("expected_value")), "risk": risk}


def composite(weights: Mapping[str, float] = lx.RANKING_WEIGHTS, vector_novelty: Column | None = None, completeness: Column | None = None) -> Column:
    """Weighted criteria, and a twentieth of the graph's completeness."""
    total = F.lit(0.0)
    for name, value in criteria(vector_novelty).items():
        total = total + F.lit(float(weights.get(name, 0.0))) * value
    return total if completeness is None else total + 0.05 * completeness


def rank_hypotheses(hyps: DataFrame, weights: Mapping[str, float] = lx.RANKING_WEIGHTS, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Composite (9 digits, so that equal scores are equal) and rank within a run; ties by hyp_id."""
    return ranked_wide(hyps.withColumn("composite", F.round(composite(weights), 9)), list(by), [F.desc("composite"), F.asc("hyp_id")])


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _long(c: str, n: int) -> Column:
    return F.length(tx.strip(_text(c))) >= n


def _first_failing(*cases: tuple[Column, str]) -> Column:
    out = F.lit("")
    for bad, note in reversed(cases):
        out = F.when(bad, F.lit(note)).otherwise(out)
    return out


# Wording that compares, names resources and states criteria. The notes of the checks below are fixed values as well.
_COMPARISON = r"новизн|известн|в отличие|аналог|существующ|типов|стандартн|согласно|источник|типичн|распростран|в сравнении|отличается"
_RESOURCES = r"ресурс|оборудован|реагент|лаборатор|персонал|бюджет|установк|проб|образец|кг|л\b|мл\b|время|час"
_CRITERIA = r"критери|успех|провал|порог|ожидаем|если\s|при\s+достижен|сравнить|контроль|базов|\d+\s*%|процент"


def _testable() -> Column:
    both = F.concat_ws(" ", _text("text"), _text("mechanism"))
    return _first_failing(
        (~_long("text", 40), "Формулировка слишком короткая"),
        (~tx.matches(both, lx.TESTABLE_ACTION), "Нет проверяемого утверждения (ожидаемый эффект)"),
        (~(tx.is_measurable(both) | tx.is_intervention(both)), "Нет конкретных параметров (%, единицы, режим, состав и т.п.)"),
        (tx.matches(both, r"\bможет\b") & ~both.rlike(r"\d+[.,]?\d*\s*%"), "Размытая формулировка «может» без количественного эффекта"),
    )


def _reasoning() -> Column:
    return _first_failing((~_long("reasoning", 40), "Обоснование отсутствует или короче 40 символов"), (tx.matches(_text("reasoning"), r"мозгов\w*\s*штурм"), "Обоснование без привязки к источникам (мозговой штурм)"))


def _sources() -> Column:
    good = F.exists("sources", lambda s: (s["doc_id"] != "") & (s["doc_id"] != "unknown") & (F.length(tx.strip(s["snippet"])) >= 15))
    return _first_failing((F.size("sources") <= 0, "Нет ссылок на источники"), (~good, "Источники без doc_id или цитаты"))


def _novelty() -> Column:
    compared = tx.matches_words(F.concat_ws(" ", _text("reasoning"), _text("text"), _text("mechanism")), _COMPARISON)
    return _first_failing((~F.col("novelty").between(1, 10), "Некорректная оценка новизны"), ((F.col("novelty") < 7) & ~compared, "Нет сравнения с известными решениями"))


def _risks() -> Column:
    a, b = F.col("risk_technical"), F.col("risk_economic")
    return _first_failing((~(a.between(0, 10) & b.between(0, 10)), "Некорректные оценки риска"), ((a == 5) & (b == 5), "Риски выглядят как дефолтные (5/5), нужна оценка"))


def _kpi(problem: Column) -> Column:
    markers = F.filter(tx.kpi_markers(problem), lambda w: F.length(w) > 4)
    # lower case is dear: a wording is taken to it once
    return tx.let(F.lower(F.concat_ws(" ", _text("text"), _text("reasoning"), _text("mechanism"))), lambda low: _first_failing(
        (~F.col("expected_value").between(1, 10), "Некорректная оценка ценности"), (~F.exists(markers, lambda w: low.contains(w)), "Нет связи с формулировкой задачи"), (~tx.matches(low, lx.VALUE_LINK), "Нет явной связи с целевым KPI"),
    ))


def _roadmap(pattern: str, note: str) -> Column:
    text = F.array_join(F.coalesce("roadmap", F.array().cast("array<string>")), " ")  # a pattern does not tell cases apart
    return _first_failing((text == "", "Дорожная карта отсутствует"), (~tx.matches_words(text, pattern), note))


#: Name -> (required, note expression; an empty note is a pass). Replace or add entries to change the checklist.
CHECKS: dict[str, tuple[bool, Callable[[Column], Column]]] = {
    "testable_formulation": (True, lambda p: _testable()),
    "reasoning": (True, lambda p: _reasoning()),
    "sources": (True, lambda p: _sources()),
    "mechanism": (True, lambda p: _first_failing((~_long("mechanism", 15), "Механизм влияния не описан"))),
    "novelty": (True, lambda p: _novelty()),
    "risks": (True, lambda p: _risks()),
    "kpi_value": (True, _kpi),
    "roadmap_steps": (False, lambda p: _first_failing((F.coalesce(F.size("roadmap"), F.lit(0)) < 2, "Меньше 2 шагов экспериментов"))),
    "roadmap_resources": (False, lambda p: _roadmap(_RESOURCES, "Не указаны ресурсы (оборудование, реагенты, образцы)")),
    "roadmap_criteria": (False, lambda p: _roadmap(_CRITERIA, "Нет критериев успеха/провала")),
}


def _influence_graph() -> Column:
    """Hyps has graph_issues (H15); recommendations alone do not fail it."""
    issues = F.coalesce("graph_issues", F.array().cast("array<string>"))
    hard = F.filter(issues, lambda i: ~i.startswith(RECOMMENDATION))
    return F.when(F.size(hard) > 0, F.array_join(hard, "; ")).otherwise(F.array_join(issues, "; "))


def _business_case() -> Column:
    """Hyps has business_case STRUCT<target_kpi, delta_pct, revenue, narrative>."""
    case = F.col("business_case")
    return _first_failing(
        (case.isNull(), "Бизнес-кейс не сформирован"),
        (F.coalesce(case["target_kpi"], F.lit("")) == "", "Не указан целевой KPI"),
        (case["delta_pct"].isNull() & case["revenue"].isNull(), "Нет количественной оценки эффекта"),
        (F.length(F.coalesce(case["narrative"], F.lit(""))) < 40, "Нет текстового бизнес-обоснования"),
    )


RECOMMENDATION = "Рекомендация"
#: The checklist of hypotheses that have a graph and a business case (proposals.enriched()).
WHOLE_CHECKS = CHECKS | {"influence_graph": (False, lambda p: _influence_graph()), "business_case": (False, lambda p: _business_case())}


def checks(hyps: DataFrame, problem: Column, table: Mapping[str, tuple[bool, Callable[[Column], Column]]] = CHECKS) -> DataFrame:
    """J05 to J12 (with WHOLE_CHECKS J13 as well): a row for each hypothesis and check: hyp_id, at, key, required, passed,
    note. problem: a column of hyps. A note that only recommends is a pass."""
    items = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("key"), F.lit(r).alias("required"), f(problem).alias("note")) for i, (k, (r, f)) in enumerate(table.items())])
    c = hyps.select("hyp_id", F.explode(items).alias("c")).select("hyp_id", "c.*")
    return c.select("hyp_id", "at", "key", "required", ((F.col("note") == "") | F.col("note").startswith(RECOMMENDATION)).alias("passed"), "note")


def compliance(checked: DataFrame) -> DataFrame:
    """Counts, and the share of required checks passed in percent."""
    required, passed = F.col("required"), F.col("passed")
    by = checked.groupBy("hyp_id").agg(F.count_if(required & passed).alias("mandatory_passed"), F.count_if(required).alias("mandatory_total"), F.count_if(~required & passed).alias("optional_passed"), F.count_if(~required).alias("optional_total"))
    return _shared_out(by)


def _shared_out(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"all_mandatory_met": F.col("mandatory_passed") == F.col("mandatory_total"), "compliance_pct": F.round(100 * F.col("mandatory_passed") / F.greatest("mandatory_total", F.lit(1)), 1)})


def with_compliance(hyps: DataFrame, problem: Column, table: Mapping[str, tuple[bool, Callable[[Column], Column]]] = CHECKS) -> DataFrame:
    """hyps with compliance() of their checks(), counted in each row: nothing is exploded, dealt out or joined."""
    noted = hyps.withColumn("__notes", F.array(*[f(problem) for _, f in table.values()]))  # each note is worked out once
    note = lambda i: F.get("__notes", i)
    ok = [((note(i) == "") | note(i).startswith(RECOMMENDATION), r) for i, (r, _) in enumerate(table.values())]
    n = lambda kind: sum((p.cast("long") for p, r in ok if r == kind), F.lit(0).cast("long"))
    total = lambda kind: F.lit(sum(r == kind for _, r in ok)).cast("long")
    counted = noted.withColumns({"mandatory_passed": n(True), "mandatory_total": total(True), "optional_passed": n(False), "optional_total": total(False)})
    return _shared_out(counted.drop("__notes"))


def messages(checked: DataFrame) -> DataFrame:
    """Per hypothesis the failed required checks (issues) and the failed others (warnings), in order."""
    line = F.concat(F.when(F.col("required"), "ТЗ: ").otherwise("Рекомендация: "), "key", F.lit(" — "), F.coalesce(F.nullif("note", F.lit("")), F.lit("не выполнено")))
    x = checked.filter(~F.col("passed")).withColumn("line", line)
    part = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.struct("at", "line"))))["line"]
    found = x.groupBy("hyp_id").agg(part(F.col("required")).alias("issues"), part(~F.col("required")).alias("warnings"))
    return checked.select("hyp_id").distinct().join(found, "hyp_id", "left")


def constraint_issues(hyps: DataFrame, constraints: Column) -> DataFrame:
    """(hyp_id, kind, low, high): ranges and values of pH outside the constraint's range; investment where the
    constraints rule it out (capex); a readiness above level 4 where they ask for that (trl). constraints: a column of hyps."""
    low = F.lower(F.coalesce(constraints, F.lit("")))
    allowed = F.get(tx.ph_ranges(constraints), 0)
    text = F.concat_ws(" ", "text", "mechanism", "reasoning")
    none = F.lit(None).cast("double")
    ranges = F.transform(F.filter(tx.ph_ranges(text), lambda r: F.greatest(r["low"], allowed["low"]) > F.least(r["high"], allowed["high"])), lambda r: F.struct(F.lit("range").alias("kind"), r["low"].alias("low"), r["high"].alias("high")))
    values = F.transform(F.filter(tx.ph_values(text), lambda v: (v < allowed["low"]) | (v > allowed["high"])), lambda v: F.struct(F.lit("value").alias("kind"), v.alias("low"), v.alias("high")))
    ruled = [(tx.contains_any(low, lx.NO_CAPEX) & tx.matches(text, lx.CAPEX), "capex"), (tx.contains_any(low, lx.TRL_4) & tx.matches(text, lx.ABOVE_TRL_4), "trl")]
    words = F.filter(F.array(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), none.alias("low"), none.alias("high"))) for cond, kind in ruled]), lambda x: x.isNotNull())
    empty = F.array().cast("array<struct<kind:string,low:double,high:double>>")
    found = F.concat(F.coalesce(ranges, empty), F.coalesce(values, empty), words)
    return hyps.select("hyp_id", F.explode(found).alias("x")).select("hyp_id", "x.*")


def with_constraint_issues(hyps: DataFrame, constraints: Column) -> DataFrame:
    """hyps with n_constraint_issues, which verdict() reads."""
    n = constraint_issues(hyps, constraints).groupBy("hyp_id").agg(F.count("*").alias("n_constraint_issues"))
    return hyps.join(n, "hyp_id", "left").withColumn("n_constraint_issues", F.coalesce("n_constraint_issues", F.lit(0)))


REVIEW = ("testability", "evidence_quality", "relevance", "novelty_assessment", "kpi_link")


def with_reviews(hyps: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewer scores of each hypothesis; a missing review is a rejection with zeros."""
    joined = hyps.join(reviews, "hyp_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in REVIEW} | {"review_approved": F.coalesce("review_approved", F.lit(False))})


def verdict(df: DataFrame, penalty: float = lx.ISSUE_PENALTY, least: float = lx.APPROVE_SCORE, floors: Sequence[float] = (6.0, 6.0, 6.0, 5.5)) -> DataFrame:
    """overall_score and approved, from reviewer scores, source_grounded, n_issues, n_constraint_issues, all_mandatory_met."""
    t, e, r, n, k = (F.col(c) for c in REVIEW)
    overall = 0.2 * t + 0.2 * e + 0.2 * r + 0.15 * n + 0.15 * k + F.when(F.col("source_grounded"), 1.0).otherwise(0.0)
    overall = F.when(F.col("n_issues") > 0, F.greatest(F.lit(0.0), overall - F.col("n_issues") * penalty)).otherwise(overall)
    scores = (t >= floors[0]) & (e >= floors[1]) & (r >= floors[2]) & (k >= floors[3])
    ok = F.col("all_mandatory_met") & F.col("source_grounded") & F.col("review_approved") & scores & (overall >= least) & (F.col("n_constraint_issues") == 0)
    return df.withColumns({"overall_score": overall, "approved": ok})


def objective(weights: Mapping[str, float] = lx.OBJECTIVE) -> Column:
    """J18."""
    return F.bround(weights["approval"] * F.when(F.col("approved"), 1.0).otherwise(0.0) + weights["score"] * F.col("overall_score") / 10, 4)


def run_index(verdicts: DataFrame, weights: Mapping[str, float] = lx.RUN_INDEX, by: str = "run_id") -> DataFrame:
    """The run's quality index, 0 to 100, and what it is made of."""
    g = verdicts.groupBy(by).agg(F.avg(F.col("approved").cast("double")).alias("approval_rate"), F.avg("overall_score").alias("avg_score"), F.avg(F.col("source_grounded").cast("double")).alias("grounding_rate"), F.count("*").alias("total"), F.count_if("approved").alias("n_approved"))
    return g.withColumn("run_index", 100 * (weights["approval"] * F.col("approval_rate") + weights["score"] * F.col("avg_score") / 10 + weights["grounding"] * F.col("grounding_rate")))


def rationale(df: DataFrame, most: int = 8) -> DataFrame:
    """The lines that explain a verdict: gates passed or missed, then issues, each once."""
    gates = F.array(
        F.when(F.col("all_mandatory_met"), "Все обязательные пункты выполнены").otherwise("Не выполнены обязательные пункты"),
        F.when(F.col("source_grounded"), "Цитаты подтверждены контекстом").otherwise("Цитаты не подтверждены контекстом"),
        F.when(F.col("review_approved"), "Рецензент одобрил").otherwise("Рецензент отклонил"),
    )
    head = F.array(F.when(F.col("approved"), "Одобрено").otherwise("Отклонено"))
    return df.withColumn("rationale", F.array_distinct(F.concat(head, gates, F.slice(F.coalesce("issues", F.array().cast("array<string>")), 1, most))))


# The lines of a decision.
_GROUNDED, _FAILED = "Цитата из источника подтверждена в RAG-контексте (пересечение ≥ {:.0%})", "Гипотеза не прошла один или несколько критериев судьи (см. замечания)"
_BLOCKING = (("Ограничения:", "Источники:"), ("цитата", "overlap", "совпала"))


def decision_rationale(df: DataFrame, checked: DataFrame, overlap: float = lx.OVERLAP_MIN, floor: float = 6.0, least: float = lx.APPROVE_SCORE, most: int = 8) -> DataFrame:
    """Df with `rationale`, the lines that explain a verdict, each once and in order.

    Approved: the reviewer's summary, the confirmed quotation, the checklist's share and a tick for each required check, the scores, the
    total, the first source. Else: the summary, the blocking issues (of constraints, sources and quotations; all issues where there are
    none; `most` of them), a cross with its note for each required check that failed. df: verdict()'s columns, REVIEW, issues, sources,
    compliance()'s columns and, where there is one, review_summary; checked: checks(), with label where keys have one.
    """
    label = F.col("label") if "label" in checked.columns else F.col("key")
    suffix = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" — "), "note")).otherwise("")
    line = F.when(F.col("passed"), F.concat(F.lit("✓ "), label)).otherwise(F.concat(F.lit("✗ "), label, suffix))
    required = checked.filter("required").withColumn("line", line).groupBy("hyp_id")
    marks = required.agg(*[F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("at", "line")))), lambda x: x["line"]).alias(n) for n, c in (("__ticks", F.col("passed")), ("__crosses", ~F.col("passed")))])
    none = F.array().cast("array<string>")
    joined = df.join(marks, "hyp_id", "left").withColumns({c: F.coalesce(c, none) for c in ("__ticks", "__crosses")})
    number = lambda c, digits=1: F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    summary = F.array(tx.strip(F.coalesce("review_summary", F.lit("")))) if "review_summary" in df.columns else none
    first = F.try_element_at("sources", F.lit(1))
    source = F.when(F.size("sources") > 0, F.concat(F.lit("Опора на источник `"), first["doc_id"], F.lit("`: «"), F.substring(tx.strip(F.coalesce(first["snippet"], F.lit(""))), 1, 80), F.lit("…»")))
    share = F.concat(F.lit("Чеклист ТЗ: "), F.col("mandatory_passed").cast("string"), F.lit("/"), F.col("mandatory_total").cast("string"), F.lit(" обязательных пунктов ("), F.format_string("%.0f", F.bround(F.col("compliance_pct"), 0)), F.lit("%)"))
    scores = F.concat(F.lit("Оценки судьи: проверяемость "), number("testability"), F.lit(", доказательства "), number("evidence_quality"), F.lit(", релевантность "), number("relevance"), F.lit(f" (пороги ≥ {floor})"))
    total = F.concat(F.lit("Итоговый балл "), number("overall_score"), F.lit(f"/10 (порог одобрения {least})"))
    approved = F.concat(summary, F.array(F.when(F.col("source_grounded"), F.lit(_GROUNDED.format(overlap)))), F.array(share), "__ticks", F.array(scores, total, source))
    issues = F.coalesce("issues", none)
    starts, words = _BLOCKING
    blocking = F.filter(issues, lambda i: _any(*[i.startswith(s) for s in starts], *[F.lower(i).contains(w) for w in words]))
    rejected = F.concat(summary, F.slice(F.when(F.size(blocking) > 0, blocking).otherwise(issues), 1, most), "__crosses")
    clean = lambda lines: F.array_distinct(F.filter(F.transform(lines, tx.strip), lambda x: x.isNotNull() & (x != "")))
    why = clean(rejected)
    lines = F.when(F.col("approved"), clean(approved)).when(F.size(why) > 0, why).otherwise(F.array(F.lit(_FAILED)))
    return joined.withColumn("rationale", lines).drop("__ticks", "__crosses")


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def summary_notes(summary: DataFrame, least_output: int = 3, target: float = 75.0) -> DataFrame:
    """run_summary() with `notes`: the index against its target, approvals, compliance, and what calls for work. n_hits: a run's
    retrieved chunks, where summary has that column."""
    whole = lambda c: F.format_string("%.0f", F.bround(c, 0))
    number = lambda c: F.col(c).cast("string")
    empty = F.when(F.col("n_hits") == 0, F.lit("⚠ База знаний пуста — запустите индексацию данных")) if "n_hits" in summary.columns else F.lit(None).cast("string")
    notes = F.array(
        F.concat(F.lit("★ JQI (по всем оценённым гипотезам): "), F.format_string("%.1f", F.col("run_index")), F.lit(f" / {target:.0f}")),
        F.concat(F.lit("★ Одобрено судьёй: "), number("n_approved"), F.lit(" из "), number("total"), F.lit(" ("), whole(100 * F.col("approval_rate")), F.lit("%)")),
        F.concat(F.lit("★ Соответствие ТЗ кейса: "), whole(F.coalesce("avg_compliance_pct", F.lit(0.0))), F.lit("% обязательных пунктов")),
        empty,
        F.when(F.col("rejected") > 0, F.concat(F.lit("⚠ "), number("rejected"), F.lit(" гипотез отклонены — требуют доработки экспертом"))),
        F.when(F.col("n_approved") < least_output, F.lit(f"⚠ Одобренных меньше целевого минимума ({least_output})")),
    )
    return summary.withColumn("notes", F.filter(notes, lambda x: x.isNotNull()))


def repair_loop(hyps: DataFrame, judge: Callable[[DataFrame], DataFrame], repairs: Callable[[DataFrame, int], DataFrame], passes: int = 1, target: float = 75.0, columns: Sequence[str] = ("text", "mechanism", "reasoning")) -> DataFrame:
    """Hypotheses judged, repaired and judged again, for at most `passes` passes.

    judge enriches and judges rows of hyps: its columns, run_id, approved, overall_score and source_grounded among others. repairs gives, for what
    is not approved of the runs that go on, and the number of the pass (from 0), new values of `columns` by hyp_id; null ones keep the old.
    A run is done when its index (J19) reaches the target, or when a pass has no repair for it; only runs that go on are judged again.
    Each pass is settled, so that lineage does not grow.
    """
    own = hyps.columns
    state = settled(judge(hyps).withColumn("passes", F.lit(0)))
    open_ = settled(run_index(state).filter(F.col("run_index") < target).select("run_id"))
    for n in range(passes):
        if open_.isEmpty():
            break
        rejected = state.join(open_, "run_id", "left_semi").filter(~F.col("approved"))
        fixes = settled(repairs(rejected, n).join(rejected.select("hyp_id", "run_id"), "hyp_id").select("hyp_id", "run_id", *[F.col(c).alias(f"__{c}") for c in columns]))
        going = fixes.select("run_id").distinct()
        if going.isEmpty():
            break
        before = state.join(going, "run_id", "left_semi").select(*own).join(fixes.drop("run_id"), "hyp_id", "left")
        again = before.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*own)
        state = settled(state.join(going, "run_id", "left_anti").unionByName(judge(again).withColumn("passes", F.lit(n + 1))))
        open_ = settled(run_index(state.join(going, "run_id", "left_semi")).filter(F.col("run_index") < target).select("run_id"))
    return state


def run_summary(verdicts: DataFrame, pct: DataFrame) -> DataFrame:
    """Totals and means of each run, with the mean share of required checks."""
    joined = verdicts.join(pct.select("hyp_id", "compliance_pct"), "hyp_id", "left")
    share = joined.groupBy("run_id").agg(F.avg("compliance_pct").alias("avg_compliance_pct"), F.count_if(~F.col("approved")).alias("rejected"))
    return run_index(verdicts).join(share, "run_id")


#: What output_order() reads.
ORDERED_BY = ("run_id", "approved", "objective", "overall_score", "composite", "hyp_id")


def output_order(df: DataFrame) -> DataFrame:
    """Approved first, then by objective, score and composite."""
    return ranked_wide(df, ["run_id"], [F.desc("approved"), F.desc("objective"), F.desc("overall_score"), F.desc("composite"), F.asc("hyp_id")])


def source_labels(df: DataFrame, known: DataFrame) -> DataFrame:
    """(hyp_id, label): a hypothesis's sources (doc_ids, in order), each with whether the context (known: hyp_id, doc_id) holds it."""
    ids = df.select("hyp_id", F.posexplode_outer("doc_ids").alias("at", "doc_id")).join(known.select("hyp_id", "doc_id").distinct().withColumn("known", F.lit(True)), ["hyp_id", "doc_id"], "left")
    part = F.concat(F.substring("doc_id", 1, 28), F.when(F.col("known"), " (✓ RAG)").otherwise(" (✗ нет в RAG)"))
    parts = ids.groupBy("hyp_id").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce(part, F.lit("")).alias("part"))))).alias("p"))
    return parts.select("hyp_id", F.when(F.size("p") > 0, F.array_join("p.part", "; ")).otherwise("—").alias("label"))


def result_table(df: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of a result list, with the share of sources that the context holds. df: hyp_id, approved, objective, overall_score, text, doc_ids."""
    ids = df.select("hyp_id", F.explode_outer("doc_ids").alias("doc_id")).join(known.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    share = ids.groupBy("hyp_id").agg(F.count("known").alias("n_known"), F.count("doc_id").alias("n_sources"))
    state = F.when(F.col("approved"), "approved").otherwise("rejected").alias("status")
    return df.join(share, "hyp_id").select("hyp_id", state, "objective", "overall_score", "n_known", "n_sources", F.substring("text", 1, 120).alias("text"))
