"""Which texts contain which patterns, without testing every pair.

Few patterns become one automaton, which goes over the texts once (Aho-Corasick). More of them, and patterns that count only
within a group, meet the texts by a gram: each pattern waits at the rarest of its grams, and only texts that have it are tested.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settled

#: The most patterns, and characters in them, that one automaton takes; it is built by each task.
PATTERNS, LETTERS = 20_000, 1_000_000
#: Letters in a gram; shorter patterns are grams themselves.
GRAM = 4


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct grams of a text; none if it is shorter. Letters are cut once, so that long texts take linear time."""
    size = F.lit(size) if isinstance(size, int) else size
    letters = F.split(text, "")
    n = F.size(letters) - size + 1
    return F.array_distinct(F.when((n > 0) & (text != ""), F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(letters, i, size), ""))).otherwise(F.array().cast("array<string>")))


def _by_automaton(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """texts: __text. A row (__text, __pattern) for each pattern that a text contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for text in batch.column(0).to_pylist() if patterns else ():
                found = {p for _, p in automaton.iter(text)}
                out[0].extend([text] * len(found))
                out[1].extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["__text", "__pattern"])

    return texts.mapInArrow(run, "__text string, __pattern string")


def _by_grams(texts: DataFrame, patterns: DataFrame, within: Sequence[str]) -> DataFrame:
    """The same for patterns (within, __pattern), by their rarest gram among all texts of the group."""
    size = F.least(F.char_length("__pattern"), F.lit(GRAM))
    asked = patterns.withColumn("__size", size)
    sizes = sorted(r[0] for r in asked.select("__size").distinct().collect())  # GRAM rows at most
    held = texts.withColumn("__size", F.explode(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"))).select(*within, "__text", "__size", F.explode(_grams(F.col("__text"), F.col("__size"))).alias("__gram"))
    held = settled(held)
    often = held.groupBy(*within, "__size", "__gram").agg(F.count("__text").alias("__often"))
    waits = asked.select(*within, "__pattern", "__size", F.explode(_grams(F.col("__pattern"), F.col("__size"))).alias("__gram"))
    waits = waits.join(often, [*within, "__size", "__gram"], "left").groupBy(*within, "__pattern", "__size").agg(F.min_by(F.struct("__gram", F.coalesce("__often", F.lit(0)).alias("__often")), F.struct(F.coalesce("__often", F.lit(0)), "__gram")).alias("__rarest"))
    waits = waits.filter("__rarest.__often > 0").select(*within, "__pattern", "__size", F.col("__rarest.__gram").alias("__gram"))
    return held.join(waits, [*within, "__size", "__gram"]).filter(F.contains("__text", "__pattern")).select(*within, "__text", "__pattern")


def containing(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, within: Sequence[str] = (), automaton: bool | None = None) -> DataFrame:
    """(within, text, pattern): each distinct text with each distinct pattern that it contains, of the same group where `within`
    names columns of both. Case counts; nulls contain nothing and are contained in nothing; the empty pattern is in every text.

    The way is chosen by the number of patterns, which is counted (automaton: True or False settles it).
    """
    within = list(within)
    own = texts.filter(F.col(text).isNotNull()).select(*within, F.col(text).alias("__text")).distinct()
    asked = patterns.filter(F.col(pattern).isNotNull()).select(*within, F.col(pattern).alias("__pattern")).distinct()
    few = None
    if within:
        empty = own.join(asked.filter("__pattern = ''"), within)
    else:
        n, letters, blank = asked.agg(F.count("__pattern"), F.coalesce(F.sum(F.char_length("__pattern")), F.lit(0)), F.count_if(F.col("__pattern") == "")).first()
        empty = own.filter(F.lit(blank > 0)).select("__text", F.lit("").alias("__pattern"))
        if automaton or (automaton is None and n <= PATTERNS and letters <= LETTERS):
            few = [r[0] for r in asked.filter("__pattern <> ''").collect()]
    asked = asked.filter("__pattern <> ''")
    found = _by_grams(own, asked, within) if few is None else _by_automaton(own, few)
    return found.unionByName(empty).withColumnsRenamed({"__text": text, "__pattern": pattern})
