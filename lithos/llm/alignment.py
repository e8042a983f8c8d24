"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers' token ends are sorted lists of byte offsets. A galloping intersection finds the offsets where tokens of
both end: they cut the tokens into groups, and the differences of their ranks in the two lists say how many tokens of each
a group has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parquet, ragged, slices, tidy, utf8
from .encoding import objects, one_thread, tokenizer_path

#: Texts are aligned in slices of about so many bytes; pairs are counted by slice before they are shuffled.
SLICE = 2 << 20
#: Bytes of the distinct pieces of text whose ids a Python worker keeps; beyond that it starts afresh.
KEPT_BYTES = 4 << 20
#: So many pieces go to a tokenizer as one text.
JOINED = 256


# ---- the tokenizers ------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """A tokenizer: ids of texts that a space stands before, and each id's bytes as one array with offsets."""

    encode: Callable[[list[str]], list[list[int]]]
    data: np.ndarray
    offsets: np.ndarray

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        return self.data[ragged(self.offsets[ids], lengths)], lengths


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file; the strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    # printable bytes stand for themselves, the others for the code points from 256 on, in their order
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    pieces = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    return Vocabulary(lambda texts: [e.ids for e in t.encode_batch_fast([f" {x}" for x in texts], add_special_tokens=False)], *_table([bytes(spelled[c] for c in p) if all(c in spelled for c in p) else p.encode() for p in pieces]))


def piece_level(path: str) -> Vocabulary:
    """A sentencepiece file, which puts the space before a text itself."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    one = re.compile(r"<0x([0-9A-F]{2})>")
    return Vocabulary(lambda texts: sp.encode(texts, num_threads=1), *_table([bytes([int(m[1], 16)]) if (m := one.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]))


def _open(path: str) -> Vocabulary:
    return piece_level(path) if path.endswith(".model") else byte_level(path)


_CUT_AFTER = np.ones(256, bool)
_CUT_AFTER[[*range(0x21), 0x7F, 0x80, 0x85, *range(0x81, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces that are encoded each by itself, and each row's first piece (with the total last).

    A piece begins at a row's start and at every space behind a byte that ends no white space (ASCII or not). No
    pre-token of a byte-level file and no piece of a sentencepiece file reaches over such a place: a space begins
    a new one there. The space itself is dropped, as encoders put it back; texts stand behind one as well.
    """
    begins = np.zeros(len(data) + 1, bool)
    inner = np.flatnonzero(data == 0x20)
    inner = inner[inner > 0]
    begins[inner[_CUT_AFTER[data[inner - 1]]]] = True
    begins[offsets[1:][offsets[1:] > 0] - 1] = False  # a row's last space stays with what is before it: encoders put no space before nothing
    begins[offsets[:-1]] = True  # a row's start; an empty row shares it with the next
    starts = np.flatnonzero(begins[:-1]) if len(data) else np.zeros(0, np.int64)
    return starts, np.searchsorted(starts, offsets)


def encoded_pieces(v: Vocabulary, pieces: list[bytes], joined: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces in a row, and how many each has.

    Up to `joined` pieces are encoded as one text, as no token reaches over a space behind a piece; which are whose is told by
    the tokens' bytes. Where these are not the text's, and behind a piece that ends in white space, pieces are encoded each by itself.
    """
    texts, bounds = [], [0]
    for i in range(1, len(pieces) + 1):
        if i == len(pieces) or i - bounds[-1] == joined or not pieces[i - 1] or not _CUT_AFTER[pieces[i - 1][-1]]:
            texts.append(b" ".join(pieces[bounds[-1] : i]).decode())
            bounds.append(i)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    ids, counts = [], np.zeros(len(pieces), np.int64)
    for s, e, text, got in zip(bounds, bounds[1:], texts, v.encode(texts), strict=False):
        if e - s > 1:
            own = np.array(got, np.int64)
            spelled, lengths = v.bytes_of(own)
            ends, want = np.cumsum(lengths), np.cumsum(sizes[s:e])
            at = np.searchsorted(ends, want)
            if spelled.tobytes() == b" " + text.encode() and np.array_equal(ends[at], want):
                ids.append(own)
                counts[s:e] = np.diff(at, prepend=-1)
                continue
            each = v.encode([p.decode() for p in pieces[s:e]])
        else:
            each = [got]
        counts[s:e] = [len(x) for x in each]
        ids.append(np.fromiter(chain.from_iterable(each), np.int64, int(counts[s:e].sum())))
    return np.concatenate([np.zeros(0, np.int64), *ids]), counts


class PairEncoder:
    """Ids by both tokenizers, piece by piece; a piece's ids are remembered."""

    def __init__(self, a: str, b: str) -> None:
        one_thread()
        self.paths, self.a, self.b = (a, b), _open(a), _open(b)
        self.by_piece = all(self._by_piece(v) for v in (self.a, self.b))
        self.clear()

    @staticmethod
    def _by_piece(v: Vocabulary) -> bool:
        """Whether a space within a token stands only at its front, behind other white space."""
        tokens = [v.data[s:e].tobytes().decode(errors="replace") for s, e in zip(v.offsets[:-1], v.offsets[1:], strict=True)]
        return all(" " not in t.lstrip() for t in tokens) and v.encode(["ab  cd.\tef\n gh"])[0] == [i for x in v.encode(["ab", " cd.\tef\n gh"]) for i in x]

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.starts = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.lengths = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def _learn(self, pieces: list[bytes]) -> None:
        for p in pieces:
            self.known[p] = len(self.known)
            self.size += len(p)
        for k, v in enumerate((self.a, self.b)):
            ids, lengths = encoded_pieces(v, pieces, JOINED if self.by_piece else 1)
            self.starts[k] = np.concatenate([self.starts[k], len(self.ids[k]) + np.cumsum(lengths) - lengths])
            self.lengths[k] = np.concatenate([self.lengths[k], lengths])
            self.ids[k] = np.concatenate([self.ids[k], ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either tokenizer the ids of all rows in a row, and each row's offsets in them. Empty rows have none."""
        starts, first = pieces_of(data, offsets) if self.by_piece else (offsets[:-1][offsets[:-1] < offsets[1:]], np.searchsorted(offsets[:-1][offsets[:-1] < offsets[1:]], offsets))
        if not len(starts):
            return [(np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))] * 2
        ends = np.append(starts[1:], len(data))
        fresh = np.isin(starts, offsets[:-1])  # the first of a row has no space of its own to drop
        heads = starts + ~fresh
        at = np.concatenate([[0], np.cumsum(ends - heads)]).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        keep = np.ones(len(data), bool)
        keep[starts[~fresh]] = False
        coded = pa.Array.from_buffers(pa.binary() if at.dtype == np.int32 else pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[keep]))]).dictionary_encode()
        pieces = objects(coded.dictionary)
        if self.size > KEPT_BYTES:
            self.clear()
        numbers = list(map(self.known.get, pieces))
        if new := [p for p, k in zip(pieces, numbers, strict=True) if k is None]:
            later = iter(range(len(self.known), len(self.known) + len(new)))
            numbers = [next(later) if k is None else k for k in numbers]
            self._learn(new)
        which = np.array(numbers, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        out = []
        for k in range(2):
            lengths = self.lengths[k][which]
            out.append((self.ids[k][ragged(self.starts[k][which], lengths)], np.concatenate([[0], np.cumsum(lengths)])[first]))
        return out


_encoder: PairEncoder | None = None


def pair_encoder(a: str, b: str) -> PairEncoder:
    """One for each Python worker."""
    global _encoder
    if _encoder is None or _encoder.paths != (a, b):
        _encoder = PairEncoder(a, b)
    return _encoder


# ---- intersection and groups ---------------------------------------------------------------------


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of `short` the first index in `long` that is not smaller (both ascending).

    Each search starts at the place of an anchor some searches before it (the first of its run), doubles its step until it
    has passed its value, and halves within the last step; all searches of the list take their steps together.
    """
    run = 4
    anchors = np.searchsorted(long, short[::run])
    low = np.repeat(anchors, run)[: len(short)]
    step = np.ones(len(short), np.int64)
    high = low.copy()
    live = np.flatnonzero((high < len(long)) & (long[np.minimum(high, len(long) - 1)] < short)) if len(long) else np.zeros(0, np.int64)
    while len(live):  # exponential: low is always before the value
        low[live] = high[live] + 1
        high[live] += step[live]
        step[live] *= 2
        inside = live[high[live] < len(long)]
        high[live] = np.minimum(high[live], len(long))
        live = inside[long[high[inside]] < short[inside]]
    live = np.flatnonzero(low < high)
    while len(live):  # binary: the answer is in [low, high]
        middle = (low[live] + high[live]) // 2
        less = long[middle] < short[live]
        low[live] = np.where(less, middle + 1, low[live])
        high[live] = np.where(less, high[live], middle)
        live = live[low[live] < high[live]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in a and in b of the values that both have; the shorter list drives."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = gallop(short, long)
    hit = np.flatnonzero((at < len(long)) & (long[np.minimum(at, len(long) - 1)] == short)) if len(long) else np.zeros(0, np.int64)
    return (hit, at[hit]) if len(a) <= len(b) else (at[hit], hit)


@dataclass
class Aligned:
    """Rows' groups: g-th group has a_ids[a_cut[g]:a_cut[g+1]] and b_ids[b_cut[g]:b_cut[g+1]]; row r has groups rows[r] to rows[r+1]."""

    ok: np.ndarray  # rows with tokens
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    rows: np.ndarray


def _kept(data: np.ndarray, offsets: np.ndarray, v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which rows' tokens spell a space and the row's bytes."""
    got, lengths = v.bytes_of(ids)
    ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
    ok = (ends[1:] - ends[:-1] == offsets[1:] - offsets[:-1] + 1) & (offsets[1:] > offsets[:-1])
    if ok.all():  # compared all at once; a row by itself only where that fails
        spelled = np.insert(data, offsets[:-1], np.uint8(0x20))
        if np.array_equal(spelled, got):
            return ok
    for r in np.flatnonzero(ok):
        part = got[ends[r] : ends[r + 1]]
        ok[r] = part[0] == 0x20 and np.array_equal(part[1:], data[offsets[r] : offsets[r + 1]])
    return ok


def _only(rows: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with the others' rows empty."""
    lengths = np.where(rows, bounds[1:] - bounds[:-1], 0)
    return ids[ragged(bounds[:-1], lengths)], np.concatenate([[0], np.cumsum(lengths)])


def align(data: np.ndarray, offsets: np.ndarray, encoder: PairEncoder) -> Aligned:
    """Groups of all rows of a slice in one intersection: rows follow one another, so that their ends ascend."""
    (a, a_rows), (b, b_rows) = encoder.encode(data, offsets)
    ok = _kept(data, offsets, encoder.a, a, a_rows) & _kept(data, offsets, encoder.b, b, b_rows)
    a, a_rows = _only(ok, a, a_rows)
    b, b_rows = _only(ok, b, b_rows)
    a_ends = np.cumsum(encoder.a.offsets[a + 1] - encoder.a.offsets[a])
    b_ends = np.cumsum(encoder.b.offsets[b + 1] - encoder.b.offsets[b])
    in_a, in_b = common_ends(a_ends, b_ends)
    a_cut, b_cut = np.insert(in_a + 1, 0, 0), np.insert(in_b + 1, 0, 0)
    return Aligned(ok, a, b, a_cut, b_cut, np.searchsorted(a_cut, a_rows))


@cache
def _decimals(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to 10**width - 1, right-aligned with room for a mark behind them, and which places of a row are used."""
    numbers = np.arange(10**width)
    digits = np.stack([*(numbers // 10**k % 10 + ord("0") for k in range(width - 1, -1, -1)), np.zeros_like(numbers)], axis=1).astype(np.uint8)
    used = np.stack([*(numbers >= 10**k for k in range(width - 1, 0, -1)), *(np.ones_like(numbers, bool),) * 2], axis=1)
    return digits, used


def written(g: Aligned) -> list[bytes]:
    """Each row's groups as a1,a2|b1;a3|b2,b3 in decimal ids."""
    n = len(g.a_cut) - 1
    rows = len(g.rows) - 1
    if not n:
        return [b""] * rows
    n_a, n_b = np.diff(g.a_cut), np.diff(g.b_cut)
    # a group's tokens: those of A, then those of B; each with the mark behind it
    at = np.cumsum(n_a + n_b) - n_a - n_b
    total = int((n_a + n_b).sum())
    ids, marks = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[ragged(at, n_a)], ids[ragged(at + n_a, n_b)] = g.a_ids[: g.a_cut[-1]], g.b_ids[: g.b_cut[-1]]
    marks[at + n_a - 1], marks[at + n_a + n_b - 1] = ord("|"), ord(";")
    digits, used = _decimals(len(str(int(ids.max()))))
    spelled = np.empty((total, digits.shape[1]), np.uint8)
    np.take(digits, ids, axis=0, out=spelled)
    spelled[:, -1] = marks
    out = spelled[np.take(used, ids, axis=0)]
    ends = np.cumsum(np.take(used.sum(axis=1), ids))
    first = np.append(at, total)[g.rows]
    bounds = np.concatenate([[0], ends])[first]
    return [out[s : max(s, e - 1)].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]  # without the last mark


def _counted(group: np.ndarray, ids: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often); ids of long groups are summed up, so that a group of many equal tokens costs little."""
    often = np.ones(len(ids), np.int64)
    many = long[group]
    if not many.any():
        return group, ids, often
    keys, n = np.unique(group[many] << 32 | ids[many], return_counts=True)
    group, ids, often = (np.concatenate(x) for x in ((group[~many], keys >> 32), (ids[~many], keys & 0xFFFFFFFF), (often[~many], n)))
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], often[order]


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_NO_PAIRS: Pairs = (np.zeros(0, np.int64),) * 4


def links(g: Aligned) -> Pairs:
    """summed() of the id pairs that share a group; a pair is A's id << 32 | B's."""
    n = len(g.a_cut) - 1
    if not n:
        return _NO_PAIRS
    n_a, n_b = np.diff(g.a_cut), np.diff(g.b_cut)
    long = n_a * n_b > 64
    a_group, a, a_often = _counted(np.repeat(np.arange(n), n_a), g.a_ids[: g.a_cut[-1]], long)
    b_group, b, b_often = _counted(np.repeat(np.arange(n), n_b), g.b_ids[: g.b_cut[-1]], long)
    b_first = np.searchsorted(b_group, np.arange(n + 1))
    partners = (b_first[1:] - b_first[:-1])[a_group]
    which = ragged(b_first[a_group], partners)
    row = np.repeat(np.searchsorted(g.rows, a_group, "right") - 1, partners)
    return summed(row, np.repeat(a, partners) << 32 | b[which], np.repeat(a_often, partners) * b_often[which])


def summed(row: np.ndarray, pair: np.ndarray, often: np.ndarray) -> Pairs:
    """Row, pair's number and how often, each (row, pair) once, sorted; and the distinct pairs by number."""
    known, code = np.unique(pair, return_inverse=True)
    key = row << 32 | code
    if (often == 1).all():  # the usual case needs no order of equal ones
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.diff(np.append(first, len(key)))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(often[order], first)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, sums, known


@dataclass
class Measured:
    """Figures of some rows."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: Pairs


def measured(data: np.ndarray, offsets: np.ndarray, encoder: PairEncoder) -> tuple[np.ndarray, Measured]:
    g = align(data, offsets, encoder)
    product = np.concatenate([[0], np.cumsum(np.diff(g.a_cut) * np.diff(g.b_cut))])[g.rows]
    return g.ok, Measured(np.diff(g.a_cut[g.rows]), np.diff(g.b_cut[g.rows]), np.diff(g.rows), np.diff(product), written(g), links(g))


def measured_long(data: np.ndarray, encoder: PairEncoder, most: int) -> Measured:
    """One long text, in parts of about `most` bytes that begin where pieces do: what stands in a task at a time stays bounded.

    The space at a part's start is dropped, as a text stands behind one.
    """
    starts, _ = pieces_of(data, np.array([0, len(data)])) if encoder.by_piece else (np.zeros(1, np.int64), None)
    cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, len(data), most), "right") - 1])
    sums, texts, pairs = np.zeros(4, np.int64), [], _NO_PAIRS
    bounds = np.append(cuts, len(data))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        part = data[s + (s > 0) : e]
        ok, m = measured(part, np.array([0, len(part)]), encoder)
        if len(part) and not ok[0]:
            return Measured(*np.zeros((4, 1), np.int64), [b""], _NO_PAIRS)
        sums += [m.n_a[0], m.n_b[0], m.n_groups[0], m.n_links[0]]
        texts.append(m.groups[0])
        pairs = summed(*(np.concatenate(x) for x in zip(*((row, known[code], often) for row, code, often, known in (pairs, m.pairs)), strict=True)))
    return Measured(*sums.reshape(4, 1), [b";".join(texts)], pairs)


# ---- the whole table -----------------------------------------------------------------------------


def _schema(key: str) -> str:
    return f"slice long, key {key}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, often array<long>, known array<long>, in_rows array<int>"


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _slices(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], digest: bool, size: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its pairs as numbers of its slice's pairs; and a row for each slice, with the pairs
    and in how many of its documents each is."""
    encoder, number = pair_encoder(*paths), TaskContext.get().partitionId() << 32
    try:
        for batch in batches:
            for part in slices(batch, "text", size):
                data, offsets = utf8(part.column(1))
                n = part.num_rows
                m = measured_long(data, encoder, size) if n == 1 and len(data) > 2 * size else measured(data, offsets, encoder)[1]
                row, code, often, known = m.pairs
                in_rows = np.bincount(code, minlength=len(known))
                bounds = np.append(np.searchsorted(row, np.arange(n + 1)), len(row))  # the slice's row has no pairs
                texts = [hashlib.sha256(g).hexdigest() if g and digest else g.decode() for g in m.groups]

                def with_none(values, kind=pa.int64()):
                    return pa.array([*values, None], kind)

                columns = [
                    pa.array(np.full(n + 1, number)), pa.concat_arrays([part.column(0), pa.nulls(1, part.column(0).type)]), *[with_none(v) for v in (m.n_a, m.n_b, m.n_groups, m.n_links)], with_none(texts, pa.string()),
                    _lists(code, bounds, pa.int32()), _lists(often, bounds, pa.int64()), _lists(known, np.append(np.zeros(n + 1, np.int64), len(known)), pa.int64()), _lists(in_rows, np.append(np.zeros(n + 1, np.int64), len(known)), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "often", "known", "in_rows"])
                number += 1
    finally:
        encoder.clear()


def _scored(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """A slice's documents with the figures of their pairs."""
    n = counts.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, bool)
    at = counts.column("at").to_numpy()
    count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    pairs, often = rows.column("pairs").combine_chunks(), rows.column("often").combine_chunks()
    code, times = pairs.flatten().to_numpy(), often.flatten().to_numpy()
    bounds = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
    summed_counts, summed_best = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (times * count[code], times * best[code]))
    out = rows.select(["key", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(summed_best, pa.int64())).append_column("count_sum", pa.array(summed_counts, pa.int64())).append_column("groups", rows.column("groups"))


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text", digest: bool = False, size: int = SLICE) -> DataFrame:
    """A row for each row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    Each text stands behind a space; A and B are a byte-level and a sentencepiece file (paths; either kind may be either).
    Groups are cut at the byte offsets where tokens of both end, and written as a1,a2|b1;a3|b2,b3 in decimal ids (with
    digest their SHA-256 in hex instead). Links are all pairs of an A and a B token of a group. A pair of ids counts once for each
    document (row) that has it linked; n_best is the number of links whose count is the highest of their A id, ties included,
    count_sum the sum of counts over links.

    Null and empty texts, and texts that A or B does not give back byte by byte, have no tokens: zeros and no groups. Repeated
    rows are documents of their own, as are rows of one key or of none. Of docs only key and text are read.

    Pairs are counted by slice (some MB of text), by pair over all slices, and taken back to the slices; of an A id's
    highest count there is a row for each id of its vocabulary, which is broadcast.
    """
    paths = (a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model"))
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    found = materialize(own.mapInArrow(tidy(lambda batches: _slices(batches, paths, digest, size)), _schema(kind)), "aligned")
    known = found.where(F.size("known") > 0).select("slice", F.posexplode(F.arrays_zip("known", "in_rows")).alias("at", "p")).select("slice", "at", F.col("p.known").alias("pair"), F.col("p.in_rows").alias("n"))
    counts = materialize(known.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))  # a row an id of A's vocabulary
    counts = counts.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a")).select(F.col("pair").alias("of"), "count", (F.col("count") == F.col("highest")).alias("best"))
    scored = known.join(counts, F.col("pair") == F.col("of")).select(F.col("slice").alias("of_slice"), "at", "count", "best")
    rows = found.where(F.col("n_a").isNotNull()).select("slice", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "often")
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return rows.groupBy("slice").cogroup(scored.groupBy("of_slice")).applyInArrow(_scored, schema).withColumnRenamed("key", key)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(parquet(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE_SQL: dict[str, str] = {}
