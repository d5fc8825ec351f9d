"""Spelling variants grouped by PartEnum signatures of letter multisets.

A word's letters form a multiset, written as a binary vector with one dimension per (letter, occurrence). One
edit moves that vector by a Hamming distance of at most two: a replaced letter by two, at equal length, an inserted
or deleted one by one. Dimensions are dealt to PARTS parts; vectors at distance k agree on all parts but k at
most, so every choice of parts to leave out gives a signature, and near words share one of them. Words with equal
signatures meet in an equi-join and are verified by edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .shingles import mix

#: Parts of the dimensions: signatures leave out two of them (equal lengths) or one (lengths that differ by one).
PARTS = 4
#: One run in so many has a code point deleted.
DELETED = 97
#: Words held by a counting task before it hands its counts on.
HELD = 500_000

#: In Latin-1: A-Z become small, U+00C0 to U+00FF stay, all that is no letter becomes a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _text(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def _counter(least_length: int, deleted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w, n in held.items() if n and len(w) >= least_length]
            out = pa.RecordBatch.from_arrays([
                pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = text.encode("latin-1", "replace").translate(_LETTERS).split()
                held.update(runs)
                start = zlib.crc32(f"{key}:".encode())
                for w in set(runs):
                    if not (h := zlib.crc32(_text(w), start)) % deleted and len(w) >= least_length:
                        n, k = runs.count(w), h % len(w)
                        held[w] -= n
                        held[w[:k] + w[k + 1:]] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return run


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, deleted: int = DELETED) -> DataFrame:
    """Columns word, n. Runs of letters, some with a code point deleted as if misspelt; see spelling_variants."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    counts = rows.mapInArrow(_counter(least_length, deleted), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


_U = np.uint64


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (word, n) to rows (signature, word, n).

    One edit also leaves one half of the longer word as it is, so words meet under a signature together with
    the length of the longer word and an equal half. That splits what would be large groups of anagrams.
    """
    left_out = [(0, c) for c in combinations(range(PARTS), 2)], [(d, (c,)) for d in (0, 1) for c in range(PARTS)]
    for batch in batches:
        words = batch.column(0).to_pylist()
        lengths = np.array([len(w) for w in words], np.int64)
        letters, row = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64), np.repeat(np.arange(len(words)), lengths)
        order = np.lexsort((letters, row))
        letters, row = letters[order], row[order]
        new = np.flatnonzero(np.diff(row * 256 + letters, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
        vectors = np.zeros((len(words), PARTS), np.uint64)
        np.add.at(vectors, (row, (letters + 3 * nth) % PARTS), mix((letters + 256 * nth + 1).astype(np.uint64)))
        total = vectors.sum(1, dtype=np.uint64)
        halves = {}
        for d in (0, 1):
            longer = lengths + d
            first, rest = longer // 2, longer - 1 - longer // 2
            halves[d] = [np.array([zlib.crc32(x.encode()) for x in side], np.uint64) for side in (
                [w[:k] for w, k in zip(words, first.tolist())], [w[len(w) - k:] for w, k in zip(words, rest.tolist())])]
        keys = []
        for same, choices in enumerate(left_out):
            for d, out in choices:
                name = _U(same * 64 + sum(1 << p for p in out))
                rest = mix(total - vectors[:, out].sum(1, dtype=np.uint64) + (name << _U(32)) + (lengths + d).astype(np.uint64))
                keys += [mix(rest ^ (half << _U(1)) ^ _U(side)) for side, half in enumerate(halves[d])]
        n = len(keys)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.stack(keys, 1).reshape(-1).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(words)), n))),
            batch.column(1).take(pa.array(np.repeat(np.arange(len(words)), n)))], names=["signature", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """Columns a, a_n, b, b_n: every pair of words (word, n) that differ by one code point, a before b, once.

    A word has 28 signatures, which Spark's size of the words does not count, so sides are merged and never broadcast.
    """
    bounded_batches(words.sparkSession)
    posted = words.select("word", "n").mapInArrow(_signatures, "signature long, word string, n long")
    a, b = posted.toDF("signature", "a", "a_n"), posted.toDF("signature", "b", "b_n")
    return a.join(b.hint("merge"), "signature").where("a < b and levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """Follow links (word, root) to their ends by doubling: counts at least double at each, so chains are short and without loops.

    The links grow with the vocabulary and lie in files much smaller than their rows in memory, so they are merged, too.
    """
    links = stored(links, "spelling-links")
    while True:
        on = links.select(F.col("word").alias("via"), F.col("root").alias("end"))
        links = stored(links.select("word", "root").join(on.hint("merge"), F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "spelling-links")
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3,
                      ratio: int = 2, deleted: int = DELETED) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n: each word with the far commoner word that it is a variant of.

    Words are runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased, of at least `least_length` code points and `least_count`
    occurrences in all texts. Where `deleted` divides h, the crc32 of "<id>:<run>", the run lacks its code point
    h % length. Two words are near if one inserted, deleted or replaced code point leads from one to the other.
    A word's form is its near word of greatest n (ties: the least in code-point order) if that n is at least `ratio` times
    the word's own, else null; `root` is the end of the chain of forms, the word itself if it has none.

    Null and empty texts have no words, a null id reads as ''. Repeated rows count each time. Other columns are
    ignored; an empty table gives an empty result.
    """
    words = stored(word_counts(docs, key, text, least_length, least_count, deleted), "spelling-words")
    pairs = near_words(words)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.struct((-F.col("b_n")).alias("least"), F.col("b").alias("form")).alias("near")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.struct((-F.col("a_n")).alias("least"), F.col("a").alias("form")).alias("near")),
    )).alias("x")).select("x.*")
    alone = words.select("word", "n", F.lit(None).cast(sides.schema["near"].dataType).alias("near"))
    best = sides.union(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), F.min("near").alias("near"))
    best = stored(best.withColumn("near", F.when(-F.col("near.least") >= ratio * F.col("n"), F.col("near"))).select(
        "word", "n", "n_near", "near.form", (-F.col("near.least")).alias("form_n")), "spelling-forms")
    roots = _roots(best.where("form is not null").select("word", F.col("form").alias("root")))
    return best.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
