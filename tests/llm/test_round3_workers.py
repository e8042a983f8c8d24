"""What a Python worker takes: threads, memory of a slice, and calls of the tokenizers."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lithos.llm import alignment, language
from lithos.llm.encoding import WordEncoder, tokenizer_path


def test_language_slice_memory():
    """A slice of distinct words, the worst case, takes less than 90 times its bytes (before: 128)."""
    text = " ".join(f"w{i:07x}" for i in range(30_000))
    part = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    language._features(language._words(part)[0])
    tracemalloc.start()
    language._features(language._words(part)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * len(text)


def test_one_thread():
    WordEncoder(tokenizer_path())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_words_for_the_model():
    """Capitals and marks behind a word need no run of the whole tokenizer."""
    mine, whole = WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = ["École réré%%% ÀÉÎÕÜÞ anoi*** les&&& x$$$ ab### Straße; é, ×! ÷? a×. b÷***", "éá%% É́* ÿ&x &amp; naïve'*"]
    ids, bounds = mine.encode(pa.array(texts), None)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]

    sent = []

    class Counting:
        def encode_batch_fast(self, words, **how):
            sent.extend(words)
            return whole.encode_batch_fast(words, **how)

    mine.clear()
    mine.tokenizer = Counting()
    mine.encode(pa.array(["École réré%%% les&&& ÀÉÎ"]))
    assert set(sent) == {"%%%", "&&&"}


def test_pieces_in_one_text():
    """Pieces that go to a tokenizer together have the ids that each has by itself, and take few calls."""
    encoder = alignment.pair_encoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    pieces = [f"w{i}{x}".encode() for i in range(300) for x in ("", ".", "\n", "é", "ﬁ", "'s", "\tab", "　", "​", "▁", "é")]
    for v in (encoder.a, encoder.b):
        each = v.encode([p.decode() for p in pieces])
        for joined in (1, 2, 7, 256):
            ids, counts = alignment.encoded_pieces(v, pieces, joined)
            assert counts.tolist() == [len(x) for x in each]
            assert ids.tolist() == [i for x in each for i in x]
    sent = []
    counting = alignment.Vocabulary(lambda texts: sent.extend(texts) or encoder.a.encode(texts), encoder.a.data, encoder.a.offsets)
    alignment.encoded_pieces(counting, [f"w{i}".encode() for i in range(1000)], 256)
    assert len(sent) == 4
    assert [x.tolist() for x in alignment.encoded_pieces(encoder.a, [], 256)] == [[], []]


def test_pairs_are_numbered():
    row, code, often, known = alignment.summed(np.array([1, 0, 1, 1]), np.array([9, 5, 9, 5]), np.array([1, 1, 1, 1]))
    assert (row.tolist(), known[code].tolist(), often.tolist()) == ([0, 1, 1], [5, 5, 9], [1, 1, 2])
    row, code, often, known = alignment.summed(np.array([1, 0, 1, 1]), np.array([9, 5, 9, 5]), np.array([3, 1, 1, 1]))
    assert (row.tolist(), known[code].tolist(), often.tolist()) == ([0, 1, 1], [5, 5, 9], [1, 1, 4])
