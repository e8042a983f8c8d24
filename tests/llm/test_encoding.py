"""The word-by-word encoder against the tokenizer itself."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lithos.llm.encoding import WordEncoder, tokenizer_path

TEXTS = [
    None, "", " ", "\t\n", "Hello, World!", "it's we'll I'M don't 'S", "3.14, a1b2!? x..., ...", "Straße ÉCOLE naïve İstanbul ΣΑΣ",
    "á é.  nbsp em", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "漢字 かな 한글.", "|||### *** &amp;", "ab\x1ccd\x85ef",
    "foo'. foo'.' a.b,c;d", "😀 emoji! 👩‍🔬", "x" * 5000 + ".", "word " * 3000,
]


PATH = tokenizer_path()
WHOLE, MINE = Tokenizer.from_file(PATH), WordEncoder(PATH)


def check(texts):
    ids, bounds = MINE.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2], t


def test_samples():
    check(TEXTS)
    for t in TEXTS:
        check([t])
    assert MINE.direct
    assert MINE.encode(pa.array([], pa.string()))[1].tolist() == [0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(texts):
    check(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aAbz09.,;:!?'’|<> \né́ßÉs")), max_size=30))
def test_near_rules(text):
    check([text])


def test_corpus():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    check(texts)
    assert np.all(MINE.encode(pa.array(texts[:3]), None)[1] >= 0)


def test_other_tokenizer():
    """A file with other rules gives its own ids."""
    path = tokenizer_path("byte_bpe_50k.json")
    whole, mine = Tokenizer.from_file(path), WordEncoder(path)
    assert not mine.by_words and MINE.by_words
    ids, bounds = mine.encode(pa.array(TEXTS, pa.string()))
    for t, a, b in zip(TEXTS, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2], t
    assert mine.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_words_are_given_up(monkeypatch):
    from lithos.llm import encoding

    monkeypatch.setattr(encoding, "KEPT_BYTES", 30)
    for _ in range(2):
        for t in TEXTS:
            check([t])
