"""Hashes of words and of word windows, for many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; longer texts are cut between words.
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Odd multipliers, one per place in a window.
PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def _powers(size: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    n = max(1024, 1 << (size - 1).bit_length())
    if n not in cache:
        cache.clear()
        cache[n] = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _BASE & (2**64 - 1), _U)]), dtype=_U)
    return cache[n]


def _hash_words(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in a buffer."""
    b = np.frombuffer(data, np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, _U)
    if lower:
        b = b + ((b >= 65) & (b <= 90)) * np.uint8(32)
    sizes = ends - starts
    b = b[word]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(b)) - np.repeat(first, sizes)
    terms = (b.astype(_U) + _U(1)) * _powers(int(sizes.max()))[place]
    return starts, mix(np.add.reduceat(terms, first))


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > CHUNK:
        m = _BLANK.search(data, at + CHUNK)
        if not m:
            break
        yield data[at:m.end()]
        at = m.end()
    yield data[at:] if at else data


def word_hashes(texts: list[str | None], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of each text's words; null texts have none."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        if held:
            starts, h = _hash_words(b" ".join(held), lower)
            ends = np.cumsum([len(d) + 1 for d in held])
            out.extend(np.split(h, np.searchsorted(starts, ends[:-1])))
            held.clear()

    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if size + len(data) > CHUNK:
            flush()
            size = 0
        if len(data) > CHUNK:
            out.append(np.concatenate([_hash_words(p, lower)[1] for p in _pieces(data)]))
        else:
            held.append(data)
            size += len(data) + 1
    flush()
    return out


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of a shorter text none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for j in range(width):
        total += words[j:j + n] * PLACES[j]
    return mix(total)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles, sorted; a shorter text with words is one shingle."""
    if 0 < len(words) < width:
        return mix(np.array([(words * PLACES[:len(words)]).sum(dtype=_U) + _U(len(words))]))
    return np.unique(windows(words, width))
