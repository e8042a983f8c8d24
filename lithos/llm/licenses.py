"""License scans by diagonal voting. DataFrame functions only.

Every run of k words of a text meets, by its hash, the places where a template has it. A vote's diagonal is its place
in the text less its place in the template; votes are summed up by diagonal, diagonals that lie next to one another
(words put in or left out) become one span, and a span stands if it holds enough of its template.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parquet

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this far apart belong to one span.
GAP = 4
#: A span must hold this share of its template's words, and be filled by them to this share.
COVERED, FILLED = 0.75, 0.6
#: A template has so many words at most: its covered words are bits of LANES longs.
LANES = 3
LONGEST = 63 * LANES


class Template(NamedTuple):
    label: str
    text: str  # words in small letters, joined by spaces
    whole: bool  # stands only if every word does, on one diagonal

    @property
    def size(self) -> int:
        """Words in a run: a phrase may have no more than two."""
        return 2 if self.whole else 3


# The phrases of the contract and the words of public license notices.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
NOTICES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", False),
    Template("apache-2.0", "licensed under the apache license version 2 0", False),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", False),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", False),
    Template("mit-release", "released under the mit license", False),
    Template(
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        False,
    ),
    Template(
        "apache-notice",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        False,
    ),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        False,
    ),
    Template(
        "bsd-notice",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        False,
    ),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", False),
    Template("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
)
TEMPLATES = PHRASES + NOTICES


def template_places(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """A row for each run of words of each template: gram, template (its number), place, and the words it covers as bits."""
    rows = []
    for number, t in enumerate(templates):
        words = t.text.split()
        if not t.size <= len(words) <= LONGEST:
            raise ValueError(f"template {t.label} must have {t.size} to {LONGEST} words")
        for place in range(len(words) - t.size + 1):
            bits = sum(1 << b for b in range(place, place + t.size))
            rows.append((words[place : place + t.size], number, t.whole, len(words), place, *[bits >> 63 * lane & (1 << 63) - 1 for lane in range(LANES)]))
    schema = "gram array<string>, template int, whole boolean, length int, place int, " + ", ".join(f"bits{i} long" for i in range(LANES))
    hashed = F.when(F.size("gram") == 2, F.xxhash64(F.get("gram", F.lit(0)), F.get("gram", F.lit(1)))).otherwise(F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(3)]))
    return spark.createDataFrame(rows, schema).withColumn("gram_hash", hashed)


def words_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest (of the whole text) and its words, A-Z in small letters; a null text is empty."""
    lowered = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(F.col(f"`{key}`").alias("key"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))


def votes(words: DataFrame, templates: DataFrame) -> DataFrame:
    """Runs of two and of three words that a template has too: key, digest, template, diagonal, at and the template's columns.

    Outer, as Spark puts a filter on the runs' number before an inner one, which works the words out anew for each run.
    The table of templates is as small as the templates are few and bounded in length, so that it is broadcast. Runs of
    equal hash are compared by their words.
    """

    def runs(size: int):
        def hashed(i):
            return F.xxhash64(*[F.get("words", i + j) for j in range(size)])

        last = F.size("words") - size
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed)).otherwise(F.array().cast("array<bigint>"))

    pairs = F.greatest(F.size("words") - 1, F.lit(0))
    grams = words.select("key", "digest", "words", pairs.alias("pairs"), F.concat(runs(2), runs(3)).alias("runs")).select("key", "digest", "words", "pairs", F.posexplode_outer("runs").alias("n", "hash"))
    at = F.when(F.col("n") < F.col("pairs"), F.col("n")).otherwise(F.col("n") - F.col("pairs"))
    same = (F.col("hash") == F.col("gram_hash")) & (F.slice("words", at + 1, F.size("gram")) == F.col("gram"))
    found = grams.join(F.broadcast(templates), same)
    return found.select("key", "digest", "template", "whole", "length", at.alias("at"), (F.size("gram") + at).alias("upto"), (at - F.col("place")).alias("diagonal"), *[f"bits{i}" for i in range(LANES)])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Places of templates in whole texts: key, digest (MD5 of the text), label, whole, first_word, last_word and share.

    A phrase (whole) stands where all its words stand consecutively. A notice's span begins and ends with the first and
    last run that it has in common with the text and holds COVERED of its template at least; share is that part.

    A row's place is known by its key and its text: repeated rows give their spans once, different texts of one key, or of
    none, their own. Null and empty texts, and an empty docs, give none. Only the columns key and text are read.
    """
    spark = docs.sparkSession
    own = ["key", "digest", "template", "whole", "length"]
    bits = [F.bit_or(f"bits{i}").alias(f"bits{i}") for i in range(LANES)]
    diagonals = votes(words_of(docs, key, text), template_places(spark, templates)).groupBy(*own, "diagonal").agg(*bits, F.min("at").alias("first_word"), F.max("upto").alias("upto"))
    ordered = Window.partitionBy("key", "digest", "template").orderBy("diagonal")
    apart = F.when(F.col("whole") | (F.col("diagonal") - F.lag("diagonal").over(ordered) > GAP), 1).otherwise(0)
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*own, "span").agg(*bits, F.min("first_word").alias("first_word"), F.max("upto").alias("upto"))
    covered = sum((F.bit_count(f"bits{i}") for i in range(1, LANES)), F.bit_count("bits0"))
    merged = merged.withColumn("covered", covered)
    stands = F.when(F.col("whole"), F.col("covered") == F.col("length")).otherwise(
        (F.col("covered") >= F.lit(COVERED) * F.col("length")) & (F.col("covered") >= F.lit(FILLED) * (F.col("upto") - F.col("first_word")))
    )
    labels = F.array(*[F.lit(t.label) for t in templates])
    return merged.where(stands).select(
        "key", "digest", F.get(labels, F.col("template")).alias("label"), "whole", "first_word", (F.col("upto") - 1).alias("last_word"), (F.col("covered") / F.col("length")).alias("share")
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """A row for each row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases; first_word and last_word are the least and the largest start among them (null
    where there is none). labels has the notices' labels too. score is the largest share of a template that stands, 0 if
    none does. Null and empty texts have no words; repeated rows stand each for itself.
    """
    base = F.col("whole")

    def joined(labels):
        return F.array_join(F.array_sort(labels), ",")

    found = spans(docs, key, text, templates).groupBy("key", "digest").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
    )
    text_ = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("own_key"), F.md5(text_).alias("own_digest"), F.regexp_count(F.translate(text_, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD)).cast("long").alias("n_words"))
    both = rows.join(found, F.col("own_key").eqNullSafe(F.col("key")) & (F.col("own_digest") == F.col("digest")), "left")
    return both.select(
        F.col("own_key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(parquet(spark, sf_dir, "documents"))


QUERIES = {"op13_license_diagonals": op13_license_diagonals}

_VALUES = ", ".join(f"({i}, '{t.label}', {t.whole}, '{t.text}')" for i, t in enumerate(TEMPLATES))
ORACLE_SQL = {
    "op13_license_diagonals": rf"""
WITH t AS (SELECT template, label, whole, string_split(phrase, ' ') AS tw FROM (VALUES {_VALUES}) v(template, label, whole, phrase)),
g AS (SELECT template, label, whole, len(tw) AS length, CASE WHEN whole THEN 2 ELSE 3 END AS size, place,
  tw[place + 1] AS a, tw[place + 2] AS b, CASE WHEN whole THEN NULL ELSE tw[place + 3] END AS c
  FROM (SELECT *, unnest(range(0, len(tw) - CASE WHEN whole THEN 1 ELSE 2 END)) AS place FROM t)),
d AS (SELECT doc_id, md5(coalesce(text, '')) AS digest,
  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, digest, unnest(words) AS a, generate_subscripts(words, 1) - 1 AS pos FROM (SELECT DISTINCT * FROM d)),
r AS (SELECT *, lead(a) OVER f AS b, lead(a, 2) OVER f AS c FROM w WINDOW f AS (PARTITION BY doc_id, digest ORDER BY pos)),
m AS (SELECT r.doc_id, r.digest, template, label, whole, length, pos, pos + size AS upto, place, size, pos - place AS diagonal
  FROM r JOIN g ON r.a = g.a AND r.b = g.b AND (g.c IS NULL OR r.c = g.c)),
l AS (SELECT DISTINCT doc_id, digest, template, whole, diagonal FROM m),
s AS (SELECT *, CASE WHEN whole OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, digest, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS apart FROM l),
k AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, digest, template ORDER BY diagonal) AS span FROM s),
x AS (SELECT m.doc_id, m.digest, m.template, m.label, m.whole, m.length, k.span, pos, upto, unnest(range(place, place + size)) AS covers
  FROM m JOIN k ON m.doc_id IS NOT DISTINCT FROM k.doc_id AND m.digest = k.digest AND m.template = k.template AND m.diagonal = k.diagonal),
y AS (SELECT doc_id, digest, label, whole, length, min(pos) AS first_word, max(upto) AS upto, count(DISTINCT covers) AS covered FROM x GROUP BY doc_id, digest, template, label, whole, length, span),
z AS (SELECT *, covered / length AS share FROM y
  WHERE CASE WHEN whole THEN covered = length ELSE covered >= {COVERED} * length AND covered >= {FILLED} * (upto - first_word) END),
a AS (SELECT doc_id, digest, count(*) FILTER (WHERE whole) AS n_base, min(first_word) FILTER (WHERE whole) AS first_word, max(first_word) FILTER (WHERE whole) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM z GROUP BY ALL)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id AND d.digest = a.digest
"""
}
