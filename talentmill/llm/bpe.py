"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a tree hold the merge rank of each adjacent pair, inner nodes the least key
rank * size + position below them: the root names the leftmost lowest-rank merge. A merge
changes three leaves, and each change climbs a logarithmic path. Many pre-tokens of similar
length are encoded together, one tree per row of an array; very long ones one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches

# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a tree array have 4, 8 ... 64 leaves; longer pre-tokens get a tree of their own.
WIDEST = 64
#: Known pieces that a worker keeps before it starts afresh: about 100 MB.
CACHED_PIECES = 400_000
NO_MERGE = np.int32(1 << 20)


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself, or the next free character from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, to_byte = spec["model"]["vocab"], byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for char, byte in to_byte.items():
            self.byte_id[byte] = ids[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, new = (np.array(x, np.int32) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs)))
        self.size, self.new_id = size, new
        keys = left.astype(np.int64) * size + right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NO_MERGE where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NO_MERGE)


def _climb(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, width: int) -> None:
    node = (leaf + width) >> 1
    while True:
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        if node[0] == 1:
            return
        node = node >> 1


def merge_rows(vocab: Vocabulary, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of byte ids to the end; returns ids and a mask of those that remain.

    sym has a power-of-two width; positions from lengths[row] on are unused.
    """
    n, width = sym.shape
    place = np.arange(width, dtype=np.int32)
    used = place < lengths[:, None]
    nxt = np.where(place + 1 < lengths[:, None], place + 1, np.int32(-1))
    prv = np.broadcast_to(place - 1, (n, width)).copy()
    leaves = np.full((n, width), NO_MERGE * width)
    pair = nxt >= 0
    rows, cols = np.nonzero(pair)
    leaves[rows, cols] = vocab.ranks(sym[rows, cols], sym[rows, cols + 1]) * width + cols
    tree = np.empty((n, 2 * width), np.int32)
    tree[:, width:] = leaves
    level = width
    while level > 1:
        half = level >> 1
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half
    active = np.arange(n)
    limit = NO_MERGE * width
    while len(active := active[tree[active, 1] < limit]):
        key = tree[active, 1]
        at, rank = key % width, key // width
        gone = nxt[active, at]
        after, before = nxt[active, gone], prv[active, at]
        sym[active, at] = vocab.new_id[rank]
        nxt[active, at] = after
        used[active, gone] = False
        tree[active, width + gone] = limit
        tree[active, width + at] = limit
        ok = after >= 0
        r, p, q = active[ok], at[ok], after[ok]
        prv[r, q] = p
        tree[r, width + p] = vocab.ranks(sym[r, p], sym[r, q]) * width + p
        ok = before >= 0
        r, p, q = active[ok], before[ok], at[ok]
        tree[r, width + p] = vocab.ranks(sym[r, p], sym[r, q]) * width + p
        _climb(tree, active, gone, width)
        _climb(tree, active, at, width)
        if len(r):
            _climb(tree, r, p, width)
    return sym, used


def merge_long(vocab: Vocabulary, data: bytes) -> np.ndarray:
    """The same for one long pre-token, with one tree in a list."""
    sym = vocab.byte_id[np.frombuffer(data, np.uint8)]
    n = len(sym)
    width = 1 << (n - 1).bit_length()
    limit = int(NO_MERGE) * width
    leaves = np.full(width, limit)
    leaves[:n - 1] = vocab.ranks(sym[:-1], sym[1:]).astype(np.int64) * width + np.arange(n - 1)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [limit, *(x for level in reversed(levels) for x in level.tolist())]
    ids, nxt, prv, used = sym.tolist(), [*range(1, n), -1], [*range(-1, n - 1)], bytearray(b"\1" * n)
    rank_of, new_id, size = vocab.rank_of, vocab.new_id, vocab.size

    def put(p: int, key: int) -> None:
        node = width + p
        tree[node] = key
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    def pair_key(a: int, b: int) -> int:
        rank = rank_of.get(ids[a] * size + ids[b])
        return limit if rank is None else rank * width + a

    while tree[1] < limit:
        rank, at = divmod(tree[1], width)
        gone = nxt[at]
        after, before = nxt[gone], prv[at]
        ids[at], nxt[at], used[gone] = int(new_id[rank]), after, 0
        put(gone, limit)
        put(at, pair_key(at, after) if after >= 0 else limit)
        if after >= 0:
            prv[after] = at
        if before >= 0:
            put(before, pair_key(before, at))
    return np.array(ids)[np.frombuffer(used, bool)]


def encode_pretokens(vocab: Vocabulary, tokens: list[str]) -> dict[str, bytes]:
    """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
    out: dict[str, bytes] = {}
    data = [t.encode("utf-8", "surrogatepass") for t in tokens]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    for i in np.flatnonzero(lengths > WIDEST).tolist():
        out[tokens[i]] = merge_long(vocab, data[i]).astype("<u4").tobytes()
    low, width = 0, 4
    while width <= WIDEST:
        group = np.flatnonzero((lengths > low) & (lengths <= width))
        for lo in range(0, len(group), 8192):
            part = group[lo:lo + 8192]
            chosen = part.tolist()
            raw = np.array([data[i] for i in chosen], f"S{width}").view(np.uint8).reshape(len(part), width)
            sym, used = merge_rows(vocab, vocab.byte_id[raw], lengths[part])
            flat, ends = sym[used].astype("<u4").tobytes(), (np.cumsum(used.sum(1)) * 4).tolist()
            out.update(zip([tokens[i] for i in chosen], [flat[a:b] for a, b in zip([0, *ends], ends)]))
        low, width = width, 2 * width
    return out


class Encoder:
    """Encodes whole texts; keeps a bounded number of known pieces between batches.

    A space before a character that is no white space always starts a pre-token, so a text
    may be looked up in pieces between spaces. A text with a piece that is empty or starts with
    white space is cut by the pattern instead.
    """

    def __init__(self, path: str) -> None:
        self.vocab = Vocabulary(path)
        self._find = regex.compile(PRETOKEN).findall
        self._blank = regex.compile(r"\s").match
        self._special = regex.compile("|".join(map(regex.escape, self.vocab.special))) if self.vocab.special else None
        self._mark = encode_pretokens(self.vocab, [".", ","])
        self._tokens: dict[str, bytes] = {}
        self._pieces: dict[str, bytes | None] = {}

    def _learn(self, tokens: Iterable[str]) -> None:
        self._tokens.update(encode_pretokens(self.vocab, [*set(filterfalse(self._tokens.__contains__, tokens))]))

    def _learn_pieces(self, pieces: set[str]) -> None:
        """Most pieces are letters, or letters and one mark: these need no pattern."""
        letters = {p for p in pieces if p.isalpha()}
        marked = {p for p in pieces - letters if p[-1:] in (".", ",") and p[:-1].isalpha()}
        fresh = [" " + p for p in letters.union(filterfalse(self._pieces.__contains__, [p[:-1] for p in marked]))]
        ids = encode_pretokens(self.vocab, fresh)
        self._pieces.update(zip([t[1:] for t in fresh], map(ids.__getitem__, fresh)))
        piece, mark = self._pieces, self._mark
        piece.update({p: piece[p[:-1]] + mark[p[-1]] for p in marked})
        cut = {p: None if not p or self._blank(p) else self._find(" " + p) for p in pieces - letters - marked}
        self._learn(t for tokens in cut.values() if tokens for t in tokens)
        known = self._tokens.__getitem__
        piece.update((p, None if tokens is None else b"".join(map(known, tokens))) for p, tokens in cut.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._pieces) > CACHED_PIECES or len(self._tokens) > CACHED_PIECES:
            self._pieces.clear()
            self._tokens.clear()
        parts = [(i, s) for i, text in enumerate(texts) for s in self._split(text)]
        split = [s.split(" ") if isinstance(s, str) else None for _, s in parts]
        missing: set[str] = set()
        for pieces in split:
            if pieces:
                missing.update(filterfalse(self._pieces.__contains__, pieces[1:]))
        self._learn_pieces(missing)
        piece, whole = self._pieces.__getitem__, []
        for (_, s), pieces in zip(parts, split):
            if pieces is None:
                whole.append(s)
                continue
            try:
                whole.append([self._find(pieces[0]), b"".join(map(piece, pieces[1:]))])
            except TypeError:
                whole.append([self._find(s), b""])
        self._learn(t for x in whole if isinstance(x, list) for t in x[0])
        out: list[list[bytes]] = [[] for _ in texts]
        token = self._tokens.__getitem__
        for (i, _), x in zip(parts, whole):
            out[i] += [x] if isinstance(x, bytes) else [*map(token, x[0]), x[1]]
        return [b"".join(x) for x in out]

    def _split(self, text: str) -> list[str | bytes]:
        """Ordinary stretches of text, and the ids of special tokens between them."""
        if not self._special or not self._special.search(text):
            return [text]
        out: list[str | bytes] = []
        at = 0
        for m in self._special.finditer(text):
            out += [text[at:m.start()], int(self.vocab.special[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return [*out, text[at:]]

    def decode(self, ids: bytes) -> str:
        token = self.vocab.bytes_of.__getitem__
        return b"".join(map(token, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           decoded: bool = False) -> DataFrame:
    """Columns `keep`, then `ids` (binary, little-endian unsigned 32-bit) and, if asked for,
    `decoded` (the text that decoding those ids gives).

    Special tokens written out in a text become their ids; none is added. Null texts count as
    empty and give no ids. One pass over the rows, no shuffle; every row stands for itself.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(*(docs[c] for c in keep), docs[text].alias("_text"))
    fields = [*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] * decoded
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = coder.encode(texts_of(batch.column("_text")))
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([coder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add `decoded` to rows of ids; null ids give the empty text."""
    bounded_batches(tokens.sparkSession)
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])
    at = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return tokens.mapInArrow(run, schema)
