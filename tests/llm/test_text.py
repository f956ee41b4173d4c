import pyarrow as pa
import pytest

from quarrylight.llm import tokens
from quarrylight.llm.simple8b import BLOCK, pack, read_segment, unpack, write_segment
from quarrylight.llm.textbytes import find_words, text_slices, word_hash, words_of, span_hashes

import numpy as np

TEXTS = ["Hello, World 12x é", None, "", "   ", "a" * 5000 + " b", "x\ny", "日本 語-A", "don't 'tree --'t", "<|endoftext|> x<|ENDOFTEXT|>", "İ ×2 é ≠ ́", "a\x0bb \x00 \x7f", "ΑΣ ΟΣ."]


def test_words_and_hashes_whatever_the_slice():
    for size in (1, 64, 1 << 20):
        found = []
        for piece in text_slices(pa.array(TEXTS), size):
            w = find_words(piece)
            h = span_hashes(piece.data, w.starts, w.ends)
            for r in range(len(piece)):
                found.append([int(x) for x in h[w.first[r] : w.first[r + 1]]])
        assert found == [[word_hash(x) for x in words_of(t)] for t in TEXTS]
    assert words_of("Hello, World 12x é") == ["hello", "world", "12x", "é"]
    assert list(text_slices(pa.array([], pa.string()))) == []


def test_encoder_equals_the_library():
    e = tokens.encoder(tokens.default_path())
    for size in (8, 1 << 20):
        for piece in text_slices(pa.array(TEXTS), size):
            ids, first = e.encode(piece)
            for r in range(len(piece)):
                want = e.tokenizer.encode(piece.text(r), add_special_tokens=False).ids
                assert ids[first[r] : first[r + 1]].tolist() == want


def test_encoder_forgets_and_relearns(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_LIMIT", 3)
    e = tokens.UnitEncoder(tokens.default_path())
    for piece in text_slices(pa.array(["one two three", "four five six", "one two three"]), 1):
        ids, _ = e.encode(piece)
        assert ids.tolist() == e.tokenizer.encode(piece.text(0), add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[], [0], [5] * 3000, list(range(3 * BLOCK + 7)), [1 << 60, 3, (1 << 64) - 1, 0], [2**k for k in range(64)] * 40, [0] * 241 + [1] * 61 + [49407] * 5])
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = pack(ids)
    assert (unpack(words, offsets, escapes, len(ids)) == ids).all()
    doc_ids, nulls, lengths, again = read_segment(write_segment(np.array([7]), np.array([True]), np.array([len(ids)]), ids))
    assert doc_ids.tolist() == [7] and nulls.tolist() == [True] and lengths.tolist() == [len(ids)] and (again == ids).all()
    with pytest.raises(ValueError):
        read_segment(b"no" + write_segment(np.array([7]), np.array([True]), np.array([0]), ids[:0])[2:])


def test_simple8b_random():
    rng = np.random.default_rng(4)
    for _ in range(30):
        ids = rng.integers(0, 1 << int(rng.integers(1, 63)), int(rng.integers(0, 4000)), dtype=np.uint64)
        words, offsets, escapes = pack(ids)
        assert (unpack(words, offsets, escapes, len(ids)) == ids).all() and offsets[-1] == len(words)
