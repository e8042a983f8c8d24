"""Token ids of whole texts by a public tokenizer file, in Arrow batches."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import lower_ascii, slices, utf8, word_spans

END = 2
#: Texts are encoded in slices of about so many bytes.
ENCODED_BYTES = 2 << 20
#: Bytes of the distinct words whose ids a Python worker keeps; beyond that it starts afresh.
KEPT_BYTES = 8 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Keeps a worker's tokenizers to their own thread: Spark's tasks share the cores already, and a pool's threads cost each worker time and memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def objects(dictionary: pa.Array) -> list[bytes]:
    return dictionary.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Encodes texts word by word and remembers each word's ids.

    This is exact for a tokenizer whose pre-tokenizer always splits at ASCII white space and drops it:
    the ids of a text are then its words' ids in a row. Punctuation at a word's end is a word of its own
    where a letter or digit stands before it, as the pre-tokenizer splits there, and A-Z is lower-cased
    first, as the normalizer does. Words of Latin letters alone are one piece of the
    pre-tokenizer, so that they go to the tokenizer's model directly; that way is taken only if it
    gives the same ids on the probe words. A tokenizer file of another kind, by its normalizer and
    pre-tokenizer, encodes whole texts.
    """

    _LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    #: Capitals that A-Z's lower-casing leaves; the normalizer makes them the small letter 32 code points on.
    _CAPITALS = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
    _PROBE = ("the", "tokenizer", "straße", "éèêîñ", "qzxjwvkq", _LETTERS, _CAPITALS)
    #: The rules of a file that may be encoded by words.
    _NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        one_thread()
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = self._splits_at_space()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): byte_level.pre_tokenize_str(c.lower())[0][0] for c in self._LETTERS + self._CAPITALS}
        self.plain = re.compile(f"[{self._LETTERS}{self._CAPITALS}]+")
        self.direct = self.by_words and all(self._model_ids(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in self._PROBE)
        self.clear()

    def _splits_at_space(self) -> bool:
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["normalizer"] or {}).get("normalizers", [])
        splits = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        space = [(x["pattern"], x["content"]) for x in steps if x["type"] == "Replace"]
        found = {k: splits[0].get(k) for k in ("pattern", "behavior", "invert")}
        return [x["type"] for x in steps] == self._NORMALIZERS and space == [({"Regex": r"\s+"}, " ")] and found == {"pattern": {"Regex": self._SPLIT}, "behavior": "Removed", "invert": True}

    def _model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.translate(self.spelling))]

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        direct = [self.direct and self.plain.fullmatch(t) is not None for t in texts]
        others = iter(self.tokenizer.encode_batch_fast([t for t, d in zip(texts, direct, strict=True) if not d], add_special_tokens=False))
        got = [self._model_ids(t) if d else next(others).ids for t, d in zip(texts, direct, strict=True)]
        for w in words:
            self.known[w] = len(self.known)
            self.size += len(w)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))])

    def encode(self, column: pa.Array, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in a row, and each row's offsets in them; null is as empty; `end` closes each row."""
        if not self.by_words:
            got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            ids, bounds = np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])
            return self._closed(ids, bounds, end)
        data, offsets = utf8(column)
        starts, ends, first = word_spans(data, offsets)
        if b"<|" not in data.tobytes():  # else a special token may stand there, which is matched as it is written
            data = lower_ascii(data)
            starts, ends, first = _split_tails(data, starts, ends, first)
        n = len(offsets) - 1
        if len(starts):
            joined = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(_offsets(ends - starts)), pa.py_buffer(_gather(data, starts, ends))])
            coded = joined.dictionary_encode()
            words = objects(coded.dictionary)
            if self.size > KEPT_BYTES:
                self.clear()
            numbers = list(map(self.known.get, words))
            if new := [w for w, k in zip(words, numbers, strict=True) if k is None]:
                fresh = iter(range(len(self.known), len(self.known) + len(new)))
                numbers = [next(fresh) if k is None else k for k in numbers]
                self._learn(new)
            which = np.array(numbers, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            lengths = self.lengths[which]
            total = np.concatenate([[0], np.cumsum(lengths)])
            ids = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - self.starts[which], lengths)]
            bounds = total[first]
        else:
            ids, bounds = np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        return self._closed(ids, bounds, end)

    @staticmethod
    def _closed(ids: np.ndarray, bounds: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))


_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?#$%&*")] = True
_STEM = np.zeros(256, bool)
_STEM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
#: Second bytes, behind 0xC3, of the Latin letters from U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def _split_tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with up to three marks of punctuation behind a letter or digit become two."""
    if not len(starts):
        return starts, ends, first
    tail = np.zeros(len(starts), np.int64)
    for _ in range(3):
        at = ends - 1 - tail
        tail += (at > starts) & _TAIL[data[np.maximum(at, 0)]] & (tail == _)
    last = ends - 1 - tail
    before = data[np.maximum(last - 1, 0)]
    tail[~(_STEM[data[last]] | (_LATIN[data[last]] & (before == 0xC3) & (last > starts)))] = 0
    cut = np.flatnonzero(tail)
    middle = ends[cut] - tail[cut]
    first = first + np.concatenate([[0], np.cumsum(tail > 0)])[first]
    new_ends = ends.copy()
    new_ends[cut] = middle
    return np.insert(starts, cut + 1, middle), np.insert(new_ends, cut + 1, ends[cut]), first


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' bytes without what lies between them."""
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    return data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]


_encoder: WordEncoder | None = None


def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    global _encoder
    if _encoder is None or _encoder.path != path:
        _encoder = WordEncoder(path)
    return _encoder


def encoded(batches: Iterator[pa.RecordBatch], text: str, path: str, end: int | None = END) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their rows' ids and offsets. The words' ids are given up at the end, as Spark keeps its Python workers."""
    own = encoder(path)
    try:
        for batch in batches:
            for part in slices(batch, text, ENCODED_BYTES):
                yield part, *own.encode(part.column(part.schema.get_field_index(text)), end)
    finally:
        own.clear()


def crc32(ids: np.ndarray, before: int = 0) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), before)
