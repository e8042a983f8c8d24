"""Text expressions: cleaning, quality, keywords, predicates, numbers. All are Catalyst expressions.

Patterns are matched with (?iU), so that letters of any script have case and \\w is Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx

LETTERS = "[а-яА-Яa-zA-Z]"
SMALL = "[а-яёa-z]"
BLANKS = " \t\n\r\f\x0b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once: inside the functions of arrays Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search; null text does not match."""
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


def matches_words(text: Column, pattern: str) -> Column:
    """matches(), for alternatives most of which are plain words: where a text has one of them as it is written, the pattern need not
    be searched, which takes far longer."""
    plain = [w for w in pattern.split("|") if re.fullmatch(r"[^\W_]+", w)]
    return let(text, lambda t: F.when(F.exists(F.array(*[F.lit(w) for w in plain]), lambda w: t.contains(w)), F.lit(True)).otherwise(matches(t, pattern)))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_number(text: Column, pattern: str) -> Column:
    """The pattern's first group as a double; null where it does not match."""
    got = F.regexp_extract(text, f"(?iU){pattern}", 1)
    return F.replace(F.when(got != "", got), F.lit(","), F.lit(".")).try_cast("double")


def normalize(text: Column, from_ocr: bool = False) -> Column:
    """Newlines of one kind, three or more of them to two, ends trimmed."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    if from_ocr:
        text = clean_ocr(text)
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_ocr(text: Column) -> Column:
    """Lines of under 2 characters go, and lines over 10 with under a quarter of letters and digits."""
    text = F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("\n")), r"[¦|]{2,}", " ")
    text = F.regexp_replace(text, r"[^\S\n]+", " ")
    lines = F.transform(F.split(text, "\n"), strip)
    keep = lambda x: (F.length(x) >= 2) & ((F.length(x) <= 10) | (count_of(x, r"[\p{L}\p{N}]") / F.length(x) >= 0.25))
    return strip(F.array_join(F.filter(lines, keep), "\n"))


def quality(text: Column) -> Column:
    """0 to 1: half the share of letters, digits and white space, half the density of words; 0 under 20 characters."""
    ratio = count_of(text, r"[\p{L}\p{N}\s]") / F.length(text)
    density = count_of(text, LETTERS + "{3,}") / F.greatest(F.length(text) / 50, F.lit(1.0))
    score = F.least(F.lit(1.0), 0.5 * ratio + 0.5 * F.least(density, F.lit(1.0)))
    return F.when(F.length(text) >= 20, score).otherwise(F.lit(0.0))


def document_id(stem: Column, text: Column, head: int = 2000) -> Column:
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(F.encode(F.substring(text, 1, head), "UTF-8"), 256), 1, 12))


def sql_document_id(title: Column, text: Column) -> Column:
    safe = F.substring(F.regexp_replace(title, r"(?U)[^\w\-]+", "_"), 1, 40)
    return F.concat(F.lit("sql_"), safe, F.lit("_"), F.substring(F.sha2(F.encode(F.substring(text, 1, 1500), "UTF-8"), 256), 1, 12))


def needs_ocr(text: Column, pages: Column) -> Column:
    """A scan: under 100 characters, or under 40 a page."""
    n = F.length(strip(F.coalesce(text, F.lit(""))))
    return (n < 100) | (n / F.greatest(pages, F.lit(1)) < 40)


def distinct_first(words: Column, most: int) -> Column:
    """Words in order, each once whatever its case, as first written; the first `most`."""
    seen = lambda acc, w: F.exists(acc, lambda x: F.lower(x) == F.lower(w))
    step = lambda acc, w: F.when((F.size(acc) >= most) | seen(acc, w), acc).otherwise(F.array_append(acc, w))
    return F.aggregate(words, F.array().cast("array<string>"), step)


def keywords(text: Column, most: int = 15) -> Column:
    return distinct_first(all_of(text, LETTERS + "{4,}"), most)


def problem_keywords(problem: Column, constraints: Column, most: int = 12) -> Column:
    return F.slice(F.array_distinct(all_of(F.lower(F.concat_ws(" ", problem, constraints)), SMALL + "{5,}")), 1, most)


def learner_words(text: Column, most: int = 25) -> Column:
    """With repeats."""
    return F.slice(all_of(F.lower(text), SMALL + "{5,}"), 1, most)


def kpi_label(problem: Column, labels: Sequence[tuple[str, str]] = lx.KPI_LABELS, default: str = lx.DEFAULT_KPI_LABEL) -> Column:
    low = F.lower(F.coalesce(problem, F.lit("")))
    word = F.regexp_extract(low, SMALL + "{6,}", 0)
    out = F.when(word != "", word).otherwise(F.lit(default))
    for label, pattern in reversed(labels):
        out = F.when(matches(low, pattern), F.lit(label)).otherwise(out)
    return out


def kpi_markers(problem: Column, labels: Sequence[tuple[str, str]] = lx.KPI_LABELS, default: str = lx.DEFAULT_KPI_LABEL) -> Column:
    words = F.filter(F.slice(all_of(F.lower(F.coalesce(problem, F.lit(""))), SMALL + "{5,}"), 1, 10), lambda w: F.length(w) > 5)
    label = kpi_label(problem, labels, default)
    head = F.when(label != default, F.array(strip(F.split_part(label, F.lit("/"), F.lit(1))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, head))


def parameters(text: Column, patterns: Sequence[tuple[str, str]] = lx.TEXT_PARAMETERS) -> Column:
    """Map of the numeric parameters that the text states, the first of each kind."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), first_number(text, p).alias("value")) for k, p in patterns])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))


def is_measurable(text: Column, patterns: Sequence[str] = lx.MEASURABLE) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p)
    return out


def is_intervention(text: Column) -> Column:
    concrete = is_measurable(text) | matches(text, lx.CONCRETE)
    return matches(text, lx.INTERVENTION) & matches(text, lx.TESTABLE_ACTION) & concrete


def overlap_form(text: Column) -> Column:
    """Lower case, ё as е, dashes and white space as one space, punctuation out."""
    text = F.translate(F.lower(text), "ё", "е")
    text = F.regexp_replace(text, r"[\s\-—–]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"\s+", " "))


def overlap_tokens(text: Column) -> Column:
    """Words of 3 or more characters, and single CJK, Kana and Hangul characters; each once."""
    words = all_of(F.lower(text), r"(?U)\w{3,}")
    return F.array_distinct(F.concat(words, all_of(text, r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")))


def dedupe_key(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")
    return F.substring(strip(F.regexp_replace(text, r"\s+", " ")), 1, 90)


_PH = r"pH\s*(\d+(?:[.,]\d+)?)"
_PH_RANGE = _PH + r"\s*[-–—]\s*(\d+(?:[.,]\d+)?)"


def _doubles(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def ph_ranges(text: Column) -> Column:
    """All ranges of pH as (low, high)."""
    a, b = (_doubles(all_of(text, f"(?i){_PH_RANGE}", g)) for g in (1, 2))
    return F.zip_with(a, b, lambda x, y: F.struct(F.least(x, y).alias("low"), F.greatest(x, y).alias("high")))


def ph_values(text: Column) -> Column:
    """Single values of pH, those of ranges apart."""
    return _doubles(all_of(F.regexp_replace(text, f"(?i){_PH_RANGE}", " "), f"(?i){_PH}", 1))


def parse_number(value: Column) -> Column:
    """The first unsigned number of a messy cell; a comma is a point. The sign is lost on purpose."""
    got = F.regexp_extract(F.replace(strip(value), F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)", 1)
    return F.when(got != "", got.cast("double"))


def clean_id(value: Column, most: int = 60) -> Column:
    return F.substring(strip(F.regexp_replace(value, r"\s+", " ")), 1, most)


def hypothesis_count(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(n, F.lit(5)), F.lit(12)))


def is_kpi_chunk(text: Column, marks: Sequence[str] = lx.KPI_CHUNK) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for m in marks:
        out = out | low.contains(m)
    return out


def kpi_boost(text: Column, marks: Sequence[str] = lx.KPI_CHUNK) -> Column:
    return F.when(is_kpi_chunk(text, marks), F.lit(0.25)).otherwise(F.lit(0.0))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out
