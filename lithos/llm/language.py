"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, parquet, slices, tidy, utf8, word_spans
from .encoding import _gather, _offsets, objects

#: Hashed features, so that the model has at most FEATURES numbers for each language, whatever the corpus.
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
#: Character n-grams within a word and the space on either side of it.
ORDERS = (1, 2, 3)
#: A text's evidence counts as that of so many n-grams at most, so that the score does not just say 1.
EVIDENCE = 60
SMOOTHING = 0.5
#: Texts are worked on in slices of about so many bytes: a slice's n-grams take up to some 80 times as much.
SLICE = 1 << 20

UNKNOWN = "und"
LETTER = r"\p{L}"


def _words(part: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the slice's texts, each word's number among them, and its row."""
    data, offsets = utf8(part.column(part.schema.get_field_index("text")))
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(_offsets(ends - starts)), pa.py_buffer(_gather(data, starts, ends))])
    coded = joined.dictionary_encode()
    words = [w.decode("utf-8", "replace") for w in objects(coded.dictionary)]
    return words, coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every n-gram of the words."""
    points = np.frombuffer((" " + " ".join(words).lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    space = points == 32
    word = np.cumsum(space, dtype=np.int32) - 1
    of, found = [], []
    for n in ORDERS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        code = np.full(size, n, np.uint64)
        ok = np.ones(size, bool)
        for i in range(n):
            code *= np.uint64(0x110001)
            code += points[i : i + size]
            if n == 1 or 0 < i < n - 1:
                ok &= ~space[i : i + size]
        at = np.flatnonzero(ok & (word[:size] < len(words)))
        of.append(word[at])
        found.append((mix64(code[at]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))
    return np.concatenate(of), np.concatenate(found)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and log probabilities (language x feature) from all rows of labelled (text, lang).

    Every task counts what it reads; Spark adds the counts up by language and feature; the driver gets
    at most FEATURES + 1 sums for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs = part.column(part.schema.get_field_index("lang")).dictionary_encode()
                names, lang_of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
                words, at, row = _words(part)
                docs = np.bincount(lang_of, minlength=len(names))
                of, feature = _features(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                for k, name in enumerate(names):
                    total = counts.setdefault(name, np.zeros(FEATURES + 1, np.int64))
                    total[FEATURES] += docs[k]
                    if words:
                        often = np.bincount(at[lang_of[row] == k], minlength=len(words))
                        total[:FEATURES] += np.bincount(feature, weights=often[of], minlength=FEATURES).astype(np.int64)
        for name, total in counts.items():
            feature = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(feature), pa.string()), pa.array(feature, pa.int32()), pa.array(total[feature], pa.int64())], ["lang", "feature", "n"])

    sums = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(tidy(run), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    counts = np.zeros((len(langs), FEATURES + 1))
    at = np.searchsorted(np.array(langs, object), np.array(sums["lang"].to_pylist(), object)) if langs else np.zeros(0, int)
    counts[at, sums["feature"].to_numpy()] = sums["n"].to_numpy()
    docs, seen = counts[:, FEATURES], counts[:, :FEATURES] + SMOOTHING
    return langs, np.log(docs / max(docs.sum(), 1)), np.log(seen / seen.sum(axis=1, keepdims=True)) if langs else seen


def predict(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """df (with text) and lang_pred, score. Null texts, texts without a letter and an empty model give `und`, 0.

    The score is the language's share of the posterior, where longer texts count as EVIDENCE n-grams.
    Ties go to the language that is first by code point. Columns named lang_pred or score are replaced.
    """
    spark = df.sparkSession
    df = df.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)  # FEATURES + 1 numbers for each language
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = part.num_rows
                letters = part.column(part.schema.get_field_index("__letters")).to_numpy(zero_copy_only=False)
                total, grams = np.tile(prior, (rows, 1)) if langs else np.zeros((rows, 0)), np.zeros(rows)
                words, at, row = _words(part)
                if words and langs:
                    of, feature = _features(words)
                    grams = np.bincount(row, weights=np.bincount(of, minlength=len(words))[at], minlength=rows)
                    for k in range(len(langs)):
                        by_word = np.bincount(of, weights=logp[k][feature], minlength=len(words))
                        total[:, k] += np.bincount(row, weights=by_word[at], minlength=rows)
                guess, score = np.full(rows, UNKNOWN, object), np.zeros(rows)
                if langs:
                    best = total.argmax(axis=1)
                    scaled = (total - total.max(axis=1, keepdims=True)) * np.minimum(1, EVIDENCE / np.maximum(grams, 1))[:, None]
                    known = letters.astype(bool)
                    guess[known] = np.array(langs, object)[best[known]]
                    score[known] = (1 / np.exp(scaled).sum(axis=1))[known]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(guess, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return df.withColumn("__letters", F.coalesce(F.col("text").rlike(LETTER), F.lit(False))).mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those whose language is unknown or holds less than `least` of the posterior; lang is the predicted one.

    The model learns from docs itself: text and non-null lang of those that held_out() leaves. Where no such row
    has a lang there is no model and nothing to reject by: only null texts and those without a letter go, and lang
    stays as it is. Each row is judged by its text alone, so that repeated rows and equal texts fare alike, whatever their
    doc_id; whole texts count, however long; ties go to the language that is first by code point; an empty df gives no rows.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    if not model[0]:
        return docs.filter(F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    names = {c: c if c == "text" else f"__{i}" for i, c in enumerate(docs.columns)}  # no clash with predict's columns
    kept = predict(docs.toDF(*names.values()), model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("lang_pred" if c == "lang" else own).alias(c) for c, own in names.items()])


def op6_language_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op6_language_nb": op6_language_nb}
ORACLE_SQL: dict[str, str] = {}
