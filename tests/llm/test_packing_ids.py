"""Ids of words, written as bytes."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from quillcell.llm.packing import Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("ids", [[], [7], [0, 256, 49_151]])
def test_ids_are_packed_as_numpy_writes_them(encoder, ids):
    assert encoder._packed(ids) == np.array(ids, dtype=encoder.dtype).tobytes()


def test_special_tokens_are_found_as_they_are_written(encoder):
    assert encoder.special.search("a<|endoftext|>b") and not encoder.special.search("a<endoftext>b|")


def test_words_have_the_ids_of_the_whole_tokenizer(encoder):
    texts = ["it's a<|endoftext|>b c", "ab'dog 12 ''s !'s x", "", "Ünïcode ﬁ naïve <|x|>", "a\tb\n\nc"]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, encoder.dtype).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
