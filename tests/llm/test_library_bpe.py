"""The library's ids against the segment trees and the tokenizer itself."""

from __future__ import annotations

import copy

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from talentmill.llm import librarybpe
from talentmill.llm.bpe import Encoder, Vocabulary

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY, TREES = librarybpe.LibraryEncoder(PATH), Encoder(PATH)
TOKENIZER = Tokenizer.from_file(PATH)


def ids(texts):
    return [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_the_vocabulary_merges_by_content():
    vocab = Vocabulary(PATH)
    assert librarybpe.merges_by_content(vocab)
    twice = copy.copy(vocab)
    twice.new_id = vocab.new_id.copy()
    twice.new_id[7] = twice.new_id[8]
    assert not librarybpe.merges_by_content(twice)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  ab\n\t'sé日<|endoftext|>.,7"), st.characters(exclude_categories=("Cs", "Cn"))), max_size=60), max_size=4))
def test_texts_of_any_kind(texts):
    texts += ["", "<|endoftext|> a<|endoftext|>"]
    assert LIBRARY.encode(texts) == ids(texts) == TREES.encode(texts)


@pytest.mark.parametrize("text", [" " * 900 + "x", "\n " * 500 + "\tz", "ab" * 700, "word next\n " * 300, "é日 " * 300, "  a" * 300, "a\t" * 500])
def test_cut_stretches_and_long_runs(monkeypatch, text):
    for size in (1, 37, 1 << 17):
        monkeypatch.setattr(librarybpe, "STRETCH", size)
        assert LIBRARY.encode([text]) == ids([text])
