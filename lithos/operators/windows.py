"""Alignment of snippets with texts (C05 to C08) over arrays, as citations has it for each window.

A token stands in a window where it is a word of the text that the window holds whole, or where the window's beginning or end cuts a word down
to it; so each place of a token counts for a range of windows, and no window is put into its form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lithos.functions import lexicons as lx
from lithos.functions import text as tx

#: White space that overlap forms keep (it ends a word nevertheless).
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ALONE = re.compile("[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]")
#: So many beginnings of windows are scored at once.
STARTS = 16_384


def regular(text: Column) -> Column:
    """Whether each character of a text has its small form for itself, so that parts have that of the whole. Null is regular."""
    return F.coalesce(F.is_valid_utf8(text) & (F.length(F.lower(text)) == F.length(text)) & ~text.contains("Σ"), F.lit(True))


def lettered(text: Column) -> Column:
    """The text in lower case with a space for each character that overlap forms leave out."""
    return F.regexp_replace(F.lower(text), r"(?U)[[^\w\s]\t\n\x0B\f\r]", " ")


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def _tokens(words: str) -> list[str]:
    return list(dict.fromkeys([w for w in words.split() if len(w) > 2] + _ALONE.findall(words)))


class Wanted:
    """A snippet, lettered(), as citations.prepared() has it."""

    def __init__(self, letters: str, window: int = 24):
        self.letters = letters
        self.tokens = _tokens(_SPACES.sub(" ", letters))
        self.form = _form(letters)
        self.words = self.form.split(" ")
        self.window = min(len(self.words), window)

    @cached_property
    def rows(self) -> dict[str, int]:
        """A row for each token, those of the snippet first."""
        return {t: i for i, t in enumerate(dict.fromkeys(self.tokens + _tokens(_SPACES.sub(" ", self.form))))}

    @cached_property
    def runs(self) -> list[str]:
        return [" ".join(self.words[i : i + self.window]) for i in range(len(self.words) - self.window + 1)]

    @cached_property
    def starts(self) -> np.ndarray:
        """Whether a token may begin with a letter (its code's last 8 bits)."""
        out = np.zeros(256, bool)
        out[[ord(t[0]) & 255 for t in self.rows]] = True
        return out

    @cached_property
    def ends(self) -> np.ndarray:
        """Whether a token of a length may end with a letter."""
        out = np.zeros((256, 256), bool)
        out[[min(len(t), 255) for t in self.rows], [ord(t[-1]) & 255 for t in self.rows]] = True
        return out

    @cached_property
    def shared(self) -> np.ndarray:
        """Which run has which token."""
        out = np.zeros((len(self.runs), len(self.rows)), np.float32)
        for i, r in enumerate(self.runs):
            out[i, [self.rows[t] for t in _tokens(_SPACES.sub(" ", r))]] = 1
        return out


def _form(letters: str) -> str:
    return " ".join(filter(None, letters.replace("ё", "е").split(" ")))


_wanted = lru_cache(4096)(Wanted)


class Corpus:
    def __init__(self, letters: str):
        self.letters = letters
        self.words = _SPACES.sub(" ", letters)
        self.form = _form(letters)

    @cached_property
    def tokens(self) -> set[str]:
        """Its words of any length, and what stands alone."""
        return {*self.words.split(), *(() if self.words.isascii() else _ALONE.findall(self.words))}


def overlap(s: Wanted, c: Corpus) -> float:
    """citations.citation_overlap()."""
    if s.form and s.form in c.form:
        return 1.0
    own = sum(t in c.tokens for t in s.tokens) / len(s.tokens) if s.tokens else 0.0
    if not s.form or not c.form or len(s.words) < 4:
        return own
    if any(r in c.form for r in s.runs):
        return 1.0
    met, sizes = s.shared @ np.array([t in c.tokens for t in s.rows], np.float32), s.shared.sum(axis=1)
    return max([own, *(float(m) / float(n) for m, n in zip(met, sizes, strict=True) if n)])


def best(s: Wanted, terms: Sequence[str], c: Corpus, low: str | None, step: int, lengths: tuple[int, ...]) -> tuple[float, int, int] | None:
    """(score, start, length) of the best window, as citations._best() has it: the first length and start of equals. low: the text in lower
    case, where terms count."""
    text = c.letters
    shortest = min(100, len(text))
    widths = [n for n in lengths if n >= shortest]
    count, found = max(0, len(text) - shortest) // step + 1, None  # windows begin at 0, step, ...
    for first in range(0, count, STARTS):
        at, end = first * step, (first + STARTS) * step + max(lengths)
        part = c if count <= STARTS else Corpus(text[at:end])
        for turn, (score, start) in enumerate(_scored(s, terms, part, low and low[at:end], step, widths, min(STARTS, count - first))):
            if found is None or (score, -turn) > found[:2]:
                found = score, -turn, at + start
    return found and (found[0], found[2], widths[-found[1]])


def _scored(s: Wanted, terms: Sequence[str], c: Corpus, low: str | None, step: int, widths: list[int], count: int) -> Iterator[tuple[float, int]]:
    """For each width the highest score of the first `count` windows, and where the first of them begins."""
    words, size, rows = c.words, len(c.words), s.rows
    #: (row, first, end): a window counts a row if it begins at `first` at most and reaches `end`
    spans: list[tuple[int, int, int]] = []
    padded = f" {words} "
    for t, row in rows.items():
        if len(t) == 1:
            spans.extend((row, p, p + 1) for p in _places(words, t))
        elif t in c.tokens:
            spans.extend((row, p, p + len(t)) for p in _places(padded, f" {t} "))
    # (turn, row, begin of the window): words that a window's beginning or end cuts
    cut: list[tuple[int, int, int]] = []
    if size and any(t in words for t in rows):
        codes = np.frombuffer(words.encode("utf-32-le"), np.uint32)
        letters = codes != 32
        at = np.arange(size)
        begins = np.maximum.accumulate(np.where(letters, 0, at + 1))  # where the word of a letter begins
        ends = np.minimum.accumulate(np.where(letters, size, at)[::-1])[::-1]  # where it ends
        inside = np.zeros(size, bool)
        inside[1:] = letters[1:] & letters[:-1]
        starts = np.arange(count) * step

        def cuts(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int]]:
            """(row, begin, end) of the words [a, b) that are tokens; most are told apart by their length and last letters."""
            some = np.flatnonzero(s.ends[np.minimum(b - a, 255), codes[b - 1] & 255] & s.starts[codes[a] & 255])
            for p, q in zip(a[some].tolist(), b[some].tolist(), strict=True):
                row = rows.get(words[p:q])
                if row is not None and q - p > 1:
                    yield row, p, q

        b = starts[starts < size]
        b = b[inside[b]]
        for row, p, end in cuts(b, ends[b]):
            cut.extend((i, row, p) for i, n in enumerate(widths) if p + n >= end)
        for i, n in enumerate(widths):
            e = starts + n
            e = e[e < size]
            e = e[inside[e]]
            # of a word longer than the window its middle
            cut.extend((i, row, end - n) for row, _, end in cuts(np.maximum(begins[e], e - n), e))
    places = None

    def stands(part: str) -> list[tuple[int, int]]:
        """(first, end) for each place of a form in that of the text."""
        nonlocal places
        if part not in c.form:
            return []
        if places is None:
            own = [(m.start(), len(m.group()) + 1) for m in re.finditer("[^ ]+", c.letters)]
            lens = np.array([n for _, n in own], np.int64)
            places = np.cumsum(lens) - lens, np.array([p for p, _ in own], np.int64)

        def at(x: int) -> int:
            k = int(np.searchsorted(places[0], x, "right")) - 1
            return int(places[1][k] + x - places[0][k])

        return [(at(x), at(x + len(part) - 1) + 1) for x in _places(c.form, part)]

    formed = stands(s.form) if s.form else []
    counted = s.form != "" and len(s.words) >= 4
    said = [(i, at) for i, r in enumerate(s.runs) if (at := stands(r))] if counted else []
    told = [list(_places(low, t)) for t in terms if t]
    held = sorted({row for row, _, _ in spans} | {row for _, row, _ in cut})
    line = {row: i for i, row in enumerate(held)}
    where = np.array(spans, np.int64).reshape(-1, 3)
    lines, firsts, ends_at = np.array([line[row] for row, _, _ in spans], np.int64), where[:, 1], where[:, 2]
    own_lines = [i for i, row in enumerate(held) if row < len(s.tokens)]
    if counted:
        shared, sizes = s.shared[:, held], s.shared.sum(axis=1, dtype=np.float64)[:, None]
    for i, n in enumerate(widths):
        # windows begin at `first` at most and reach `end` (the text's end, which no place is behind, cuts the last ones)
        span = lambda first, end: slice(-(-max(0, end - n) // step), min(first // step + 1, count))  # noqa: B023, E731
        # a place counts from its first window to behind its last one
        edges = np.zeros((len(held), count + 1), np.int32)
        low_end = -(-np.maximum(0, ends_at - n) // step)
        high_end = np.maximum(np.minimum(firsts // step + 1, count), low_end.clip(max=count))
        np.add.at(edges, (lines, low_end.clip(max=count)), 1)
        np.add.at(edges, (lines, high_end), -1)
        present = (np.cumsum(edges[:, :count], axis=1) > 0).astype(np.float32)
        for turn, row, p in cut:
            if turn == i:
                present[line[row], p // step] = 1
        score = present[own_lines].sum(axis=0, dtype=np.float64) / len(s.tokens) if own_lines else np.zeros(count)
        if counted:
            share = (shared @ present).astype(np.float64)
            share = np.divide(share, sizes, out=np.zeros_like(share), where=sizes > 0)
            for k, at in said:
                for first, end in at:
                    share[k, span(first, end)] = 1
            score = np.maximum(score, share.max(axis=0))
        for first, end in formed:
            score[span(first, end)] = 1
        if len(terms):
            score = score + 0.06 * _hits(terms, told, span, count)
        top = int(score.argmax())
        yield float(score[top]), top * step


def _hits(terms: Sequence[str], told: list[list[int]], span, count: int) -> np.ndarray:
    """How many terms each window has; the empty one is in all."""
    hits = np.full(count, sum(not t for t in terms), np.int64)
    for t, at in zip((t for t in terms if t), told, strict=True):
        has = np.zeros(count, bool)
        for p in at:
            has[span(p, p + len(t))] = True
        hits += has
    return hits


def _sentence(text: str, start: int, length: int, most: int, left: int = 80, right: int = 60) -> tuple[str, int, int]:
    """citations.sentence_bounds(), and the part of the text that it is of."""
    head = max(0, start - left)
    before, behind = text[head:start], text[start + length : start + length + right]
    a = next((head + i + len(x) for x in lx.SENTENCE_STARTS if (i := before.rfind(x)) >= 0), start)
    b = next((start + length + i + len(x.strip()) for x in lx.SENTENCE_ENDS if (i := behind.find(x)) >= 0), min(len(text), start + length))
    a, b = _stripped(text, a, b)
    if b - a > most:
        space = text.rfind(" ", a, a + most)
        a, b = _stripped(text, a, space) if space >= 0 else (a, a + most)
    return (_one_space(text[a:b]), a, b) if b > a else (text[start : start + length], start, start + length)


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    part = text[a:b]
    return a + len(part) - len(part.lstrip(tx.BLANKS)), a + len(part.rstrip(tx.BLANKS))


def _one_space(text: str) -> str:
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text)


def _by_keywords(s: Wanted, terms: Sequence[str], text: str, low: str, most: int, step: int = 40) -> tuple[int, int] | None:
    """citations.keyword_window(): the part of the text."""
    keys = [w for w in re.findall(tx.SMALL + "{5,}", s.letters) if w not in lx.KEYWORD_STOP] + list(terms)
    keys = [k for k in keys if k in low]
    count, n, found = max(0, len(text) - min(81, len(text))) // step + 1, most + 80, (0, 0)
    told = [list(_places(low, k)) for k in keys if k]
    for at in range(0, count if keys else 0, STARTS):
        some = min(STARTS, count - at)
        # in windows from `at` on
        span = lambda first, end: slice(max(0, -(-max(0, end - n) // step) - at), max(0, min(first // step + 1 - at, some)))  # noqa: B023, E731
        hits = _hits(keys, told, span, some)
        top = int(hits.argmax())
        if hits[top] > found[0]:
            found = int(hits[top]), (at + top) * step
    return _stripped(text, found[1], found[1] + most) if found[0] else None


def window(wanted: Wanted, said: str, terms: Sequence[str], text: str, c: Corpus, low: str, most: int, step: int) -> tuple[str, float]:
    """The excerpt for what is wanted (said: as it is written), and its overlap."""
    found = best(wanted, terms, c, low, step, (most, most + 50, most - 30))
    if found and found[0] > 0:
        _, start, length = found
        excerpt, a, b = _sentence(text, start, len(text[start : start + length].strip(tx.BLANKS)), most)
        return excerpt, overlap(Wanted(c.letters[a:b]), c)
    part = _by_keywords(wanted, terms, text, low, most)
    if part is None:
        return said[:most], overlap(_wanted(wanted.letters[:most]), c)
    return _one_space(text[part[0] : part[1]]), overlap(Wanted(c.letters[part[0] : part[1]]), c)


def aligned(snippet: str, letters: str, text: str, c: Corpus, low: str | None, hint: str | None, hint_letters: str | None, terms: Sequence[str], raw: float | None, raw_known: bool, most: int) -> tuple[str, float]:
    """citations.align() for one pair that is not blank."""
    wanted = _wanted(letters)
    exact = wanted.form in c.form
    terms = [] if exact else list(terms)
    low = c.letters if low is None else low  # words stand alike in both
    excerpt, over = window(wanted, snippet, terms, text, c, low, most, 20)
    if exact:
        return excerpt, 1.0
    if hint:
        other, hint_over = window(_wanted(hint_letters), hint, terms, text, c, low, most, 20)
        if hint_over > over + 0.05:
            excerpt, over = other, hint_over
    if over < 1 and not raw_known:  # none is more than 1
        raw = overlap(wanted, c)
    if raw is not None and over < raw and raw >= 0.25:
        return snippet[:most], raw
    return excerpt, over


def align(pairs: DataFrame, most: int) -> DataFrame:
    """citations.align() for pairs (pair_id, snippet, corpus, hypothesis, terms, raw, raw_known) that are regular()."""
    schema = StructType([pairs.schema["pair_id"], StructField("aligned", StringType()), StructField("overlap", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, c = None, None
        for batch in batches:
            ids, *columns = batch.columns
            out: tuple[list, list] = ([], [])
            for i in range(batch.num_rows):
                snippet, letters, text, text_letters, low, hint, hint_letters, terms, raw, raw_known = (x[i].as_py() for x in columns)
                if not (snippet or "").strip(tx.BLANKS) or not text:
                    got = snippet and snippet[:most], 0.0
                else:
                    if text_letters != last:
                        last, c = text_letters, Corpus(text_letters)
                    got = aligned(snippet, letters, text, c, low, hint, hint_letters, terms or [], raw, raw_known, most)
                out[0].append(got[0])
                out[1].append(got[1])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64())], names=["pair_id", "aligned", "overlap"])

    given = pairs.select(
        "pair_id", "snippet", lettered(F.col("snippet")).alias("letters"), "corpus", lettered(F.col("corpus")).alias("text_letters"), F.when(F.size("terms") > 0, F.lower("corpus")).alias("low"),
        "hypothesis", lettered(F.col("hypothesis")).alias("hint_letters"), F.transform("terms", F.lower).alias("terms"), "raw", "raw_known",
    )
    return given.mapInArrow(run, schema)
