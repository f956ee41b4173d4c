import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import surrogates, tokens
from quarrylight.llm.decontaminate import suffix_array
from quarrylight.llm.simple8b import pack, unpack
from quarrylight.llm.textbytes import text_slices, words_of

RULE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOWN = {i: i + 32 for i in range(65, 91)}
texts = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'<|>aBcéßñÉİſ0159.,!-_́ ")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_words_follow_the_rule(text):
    assert words_of(text) == RULE.findall(text.translate(DOWN))


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_encoder_equals_the_library(batch):
    e = tokens.encoder(tokens.default_path())
    for piece in text_slices(pa.array(batch), 64):
        ids, first = e.encode(piece)
        for r in range(len(piece)):
            assert ids[first[r] : first[r + 1]].tolist() == e.tokenizer.encode(piece.text(r), add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 2**20))
def test_simple8b(ids, small):
    ids = np.array([*ids, *[small % 7] * (small % 500)], np.uint64)
    words, offsets, escapes = pack(ids)
    assert (unpack(words, offsets, escapes, len(ids)) == ids).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_suffix_order(text):
    assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["a.b@c.org", "+1 (212) 555-0187", "4111 1111 1111 1111", "10.20.30.40", "123-45-6789", "DE89 3704 0044 0532 0130 00"]), st.text("abc", min_size=1, max_size=5), st.text(max_size=8))
def test_surrogates_keep_the_kind(entity, key, around):
    (a, b, kind, form), *rest = surrogates.detect(entity)
    assert (a, b) == (0, len(entity)) and not rest
    new = surrogates.surrogate(key, kind, form)
    shown = surrogates.render(entity, kind, new)
    assert surrogates.canonical(kind, shown) == new and [x[2] for x in surrogates.detect(shown)] == [kind]
    assert surrogates.surrogate(key, kind, form) == new
