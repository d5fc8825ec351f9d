"""Ids of texts where encoding is only a step, by a public library.

The library costs a fraction of the tree arrays, above all for words that a task has never met. The segment-tree
encoder stays in use where the library's rule could differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import tiktoken

from .bpe import PRETOKEN, WIDEST, Encoder, Vocabulary, encoder, merge_long, merge_rows

#: Characters after which a text is cut for the library.
STRETCH = 1 << 17


def merges_by_content(vocab: Vocabulary) -> bool:
    """Whether merging by the content of a pair is the same as merging by the pair.

    The library merges any two neighbours whose joined bytes are a token, by the rank of that token; the vocabulary
    lists pairs. Both agree if no token is made by two pairs and every token's own bytes merge into that token: two neighbours
    that cover a token's bytes have then been merged inside by lower ranks only, as in the token alone, so they are its pair.
    """
    made = vocab.new_id.tolist()
    data = [vocab.bytes_of[i] for i in made]
    if len(set(made)) < len(made) or any(len(merge_long(vocab, d)) != 1 for d in data if len(d) > WIDEST):
        return False
    low, width = 0, 4
    while width <= WIDEST:
        part = [d for d in data if low < len(d) <= width]
        raw = np.array([np.frombuffer(d.ljust(width, b"\0"), np.uint8) for d in part], np.uint8).reshape(len(part), width)
        _, used = merge_rows(vocab, vocab.byte_id[raw], np.fromiter(map(len, part), np.int64, len(part)))
        if (used.sum(1) != 1).any():
            return False
        low, width = width, 2 * width
    return True


class LibraryEncoder(Encoder):
    """The same ids, found by the library stretch by stretch.

    A space before a character that is no white space starts a pre-token, so long texts are cut there. What cannot be
    cut below twice STRETCH, a huge run of white space or a huge word, is left to the trees.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        content = [bytes([b]) for b in range(256)] + [self.vocab.bytes_of[i] for i in self.vocab.new_id.tolist()]
        self._id_of = np.concatenate([self.vocab.byte_id, self.vocab.new_id]).astype("<u4")
        self._ranks = tiktoken.Encoding(
            "merges", pat_str=PRETOKEN, mergeable_ranks={c: i for i, c in enumerate(content)}, special_tokens={}).encode_ordinary
        self._start = re.compile(r" (?=\S)").search

    def encode(self, texts: list[str]) -> list[bytes]:
        return [
            b"".join(s if isinstance(s, bytes) else b"".join(map(self._ids, self._stretches(s))) for s in self._split(text))
            for text in texts]

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH and (found := self._start(text, at + STRETCH)):
            yield text[at:found.start()]
            at = found.start()
        yield text[at:]

    def _ids(self, text: str) -> bytes:
        if len(text) > 2 * STRETCH:
            return super().encode([text])[0]
        ranks = self._ranks(text)
        return self._id_of[np.fromiter(ranks, np.int64, len(ranks))].tobytes()


@lru_cache(maxsize=8)
def library_serves(path: str) -> bool:
    """Asked once per vocabulary, on the driver; takes about a second."""
    return merges_by_content(Vocabulary(path))


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return LibraryEncoder(path)


def fastest_encoder(path: str, library: bool) -> Encoder:
    return library_encoder(path) if library else encoder(path)
