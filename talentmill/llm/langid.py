"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams in order, and so does a document's. The
out-of-place distance adds up how far each of the document's n-grams stands from its place in the profile;
the nearest profile names the language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Longest n-gram, and n-grams in a profile; an n-gram that a profile lacks is so many places off.
LONGEST, PROFILE = 3, 300
#: Languages whose profiles are broadcast at a time: about 10 MB.
LANGUAGES = 256
#: One document in so many is held out.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Texts and characters whose n-grams are counted at a time; a longer text than LONG_TEXT is counted word by word.
GROUP_TEXTS, GROUP_CHARS, LONG_TEXT = 128, 300_000, 2_000_000
#: Possible n-grams of an alphabet up to which a table holds them all.
DENSE = 1 << 21
#: n-grams held by a counting task before it hands its counts on.
HELD = 200_000

_WORD_LIKE = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    text = (text or "").lower()
    found = _WORD_LIKE.findall(text)
    # The quick pattern also takes numerals that are no digits.
    return found if "".join(found).isalpha() else "".join(c if c.isalpha() else " " for c in text).split()


def grams_of(word: str) -> tuple[str, ...]:
    """All n-grams of a word between blanks, shown as `_`; a lone blank is none."""
    w = f"_{word}_"
    return (*word, *(w[i:i + k] for k in range(2, LONGEST + 1) for i in range(len(w) - k + 1)))


def gram_counts(words: Counter) -> Counter:
    counts: Counter = Counter()
    for word, n in words.items():
        for g in grams_of(word):
            counts[g] += n
    return counts


def ranked(counts: Counter) -> list[str]:
    """The most frequent n-grams, equal ones in code-point order."""
    return sorted(sorted(counts), key=counts.__getitem__, reverse=True)[:PROFILE]


def _letter_table(held: list = []) -> np.ndarray:  # noqa: B006
    """For each 16-bit code, whether it is a letter."""
    if not held:
        held.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    return held[0]


def quick(text: str) -> bool:
    """Whether gram_matrix can count a lower-cased text: not too long, and no letter beyond 16 bits."""
    if len(text) > LONG_TEXT:
        return False
    return text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) or not any(c > "\uffff" and c.isalpha() for c in text)


def gram_matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of quick lower-cased texts in code-point order, as packed numbers, and a row of their counts for each text.

    Letters and the blanks beside them stay; an n-gram is a window whose inner characters are letters.
    """
    data = [t.encode("utf-16-le") for t in texts]
    codes = np.frombuffer(b"\n\0" + b"\n\0".join(data) + b"\n\0", "<u2")
    letter = _letter_table()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    doc = np.repeat(np.arange(len(texts) + 1), [*(len(d) // 2 + 1 for d in data), 1])[keep]
    codes, letter = np.where(letter, codes, ord("_"))[keep], letter[keep]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros((len(texts), 0))
    used = np.zeros(1 << 16, bool)
    used[codes] = True
    alphabet = np.flatnonzero(used)
    base = len(alphabet) + 1
    rank = np.cumsum(used)[codes]
    ids, docs = [], []
    value, inner = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
    for k in range(1, LONGEST + 1):
        n = len(codes) - k + 1
        value = value[:n] * base + rank[k - 1:]
        if k > 2:
            inner = inner[:n] & letter[k - 2:k - 2 + n]
            starts = np.flatnonzero(inner)
            docs.append(doc[starts + 1])
        elif k == 2:
            starts = np.flatnonzero(letter[:-1] | letter[1:])
            docs.append(np.where(letter[starts], doc[starts], doc[starts + 1]))
        else:
            starts = np.flatnonzero(letter)
            docs.append(doc[starts])
        ids.append(value[starts] * base ** (LONGEST - k))
    ids, docs = np.concatenate(ids), np.concatenate(docs)
    if base ** LONGEST <= DENSE:
        there = np.zeros(base ** LONGEST, bool)
        there[ids] = True
        distinct, which = np.flatnonzero(there), (np.cumsum(there) - 1)[ids]
    else:
        distinct, which = np.unique(ids, return_inverse=True)
    counts = np.bincount(docs * len(distinct) + which, minlength=len(texts) * len(distinct)).reshape(len(texts), -1)
    packed, letters = np.zeros(len(distinct), np.uint64), np.append(0, alphabet).astype(np.uint64)
    for k in range(LONGEST):
        packed |= letters[distinct // base ** (LONGEST - 1 - k) % base] << np.uint64(48 - 16 * k)
    return packed, counts


def unpacked(gram: int) -> str:
    return "".join(chr(c) for k in range(48, -1, -16) if (c := gram >> k & 0xFFFF))


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Texts in groups whose counts fit in memory."""
    group: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if group and (len(group) >= GROUP_TEXTS or size + len(text) > GROUP_CHARS):
            yield group
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        yield group


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(counts), pa.string()), pa.array([g if isinstance(g, str) else unpacked(g) for g in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts = [(t or "").lower() for t in batch.column(1).to_pylist()]
        langs = batch.column(0).to_pylist()
        plain = [i for i, t in enumerate(texts) if not quick(t)]
        for i in plain:
            held.setdefault(langs[i], Counter()).update(gram_counts(Counter(words_in(texts[i]))))
            texts[i] = ""
        for group in _groups(texts):
            packed, counts = gram_matrix([texts[i] for i in group])
            kinds, of = np.unique(np.array([langs[i] for i in group], object), return_inverse=True)
            for k, lang in enumerate(kinds):
                n = counts[of == k].sum(0)
                some = np.flatnonzero(n)
                counter = held.setdefault(lang, Counter())
                for g, c in zip(packed[some].tolist(), n[some].tolist()):
                    counter[g] += c
            if sum(map(len, held.values())) >= HELD:
                yield from flush()
    yield from flush()


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns lang, gram, place (from 0): the PROFILE most frequent n-grams of each language, from all rows with a language."""
    bounded_batches(docs.sparkSession)
    known = docs.where(docs[lang].isNotNull()).select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    counts = known.mapInArrow(_learn, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    places = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE)
    return places.select("lang", "gram", (F.col("place") - 1).alias("place"))


def _top(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE items of greatest count, greatest first, equal ones in their order."""
    if len(items) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        above, equal = counts > least, items[counts == least]
        ahead = items[above][np.argsort(-counts[above], kind="stable")]
        return np.concatenate([ahead, equal[:PROFILE - len(ahead)]])
    return items[np.argsort(-counts, kind="stable")]


class _Profiles:
    """Some languages' profiles as a matrix of places."""

    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.at: dict[str, int] = {}
        for _, gram, _ in rows:
            self.at.setdefault(gram, len(self.at))
        self.places = np.full((len(self.at), len(self.langs)), -1)
        for lang, gram, place in rows:
            self.places[self.at[gram], column[lang]] = place

        packed = sorted((sum(ord(c) << (48 - 16 * k) for k, c in enumerate(g)), i) for g, i in self.at.items() if max(g) <= "\uffff")
        self.packed = np.array([g for g, _ in packed], np.uint64)
        self.row = np.array([i for _, i in packed], np.int64)

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        """Places of packed n-grams in every profile, -1 where it lacks them."""
        out = np.full((len(grams), len(self.langs)), -1)
        if len(self.packed):
            at = np.minimum(np.searchsorted(self.packed, grams), len(self.packed) - 1)
            known = self.packed[at] == grams
            out[known] = self.places[self.row[at[known]]]
        return out

    def nearest(self, places: np.ndarray) -> tuple[int, str]:
        """Least out-of-place distance of ranked n-grams, given their places, and its language (ties: the first in order)."""
        away = np.where(places < 0, PROFILE, np.abs(places - np.arange(len(places))[:, None])).sum(0)
        best = int(np.argmin(away))
        return int(away[best]), self.langs[best]

    def judge(self, texts: list[str | None]) -> list[tuple[int, str, int] | None]:
        """For each text: distance, language and number of n-grams; nothing where it has none."""
        texts = [(t or "").lower() for t in texts]
        out: list = [None] * len(texts)
        for i in [i for i, t in enumerate(texts) if not quick(t)]:
            if grams := ranked(gram_counts(Counter(words_in(texts[i])))):
                out[i] = (*self.nearest(np.array([self.places[self.at[g]] if g in self.at else [-1] * len(self.langs) for g in grams])), len(grams))
            texts[i] = ""
        for group in _groups(texts):
            packed, counts = gram_matrix([texts[i] for i in group])
            places = self.rows_of(packed)
            for i, row in zip(group, counts):
                some = np.flatnonzero(row)
                if len(some):
                    top = _top(some, row[some])
                    out[i] = (*self.nearest(places[top]), len(top))
        return out


def _score(profiles) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, distances = (batch.column(c).to_pylist() for c in ("text", "lang", "distance"))
            rows = []
            for here, lang, distance in zip(profiles.value.judge(texts), langs, distances):
                if here:
                    rows.append((*(here[:2] if distance is None else min(here[:2], (distance, lang))), PROFILE * here[2]))
                else:
                    rows.append((None, None, None))
            distance, lang, most = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 3)), pa.array(lang, pa.string()), pa.array(distance, pa.int64()), pa.array(most, pa.int64())],
                names=batch.schema.names)

    return run


def held_out(key: Column) -> Column:
    """Whether a document takes no part in learning; a null id reads as ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def identify_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns <key>, held_out, lang_pred, score: the language whose profile is nearest to each whole text.

    Profiles are learned from all texts with a language that are not held out (crc32 of the id modulo FOLDS). A text without letters, null
    too, is `und` with score 0, and so is every text if nothing was learned. The score is 1 - distance / greatest possible
    distance. Equal distances go to the language first in code-point order, equal n-gram counts to the
    n-gram first in that order. Rows are judged one by one, repeated ones alike; a null id reads as ''.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    mine = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang"), held_out(docs[key]).alias("held_out"))
    profiles = stored(language_profiles(mine.where("not held_out")), "language-profiles")
    blocks = -(-profiles.select("lang").distinct().count() // LANGUAGES)
    out = mine.select("key", "held_out", "text", F.lit(None).cast("string").alias("lang"),
                      F.lit(None).cast("long").alias("distance"), F.lit(None).cast("long").alias("most"))
    for block in range(blocks):
        rows = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).collect()
        if rows:
            shared = spark.sparkContext.broadcast(_Profiles([tuple(r) for r in rows]))
            out = out.mapInArrow(_score(shared), out.schema)
    return out.select(F.col("key").alias(key), "held_out", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang_pred"),
                      F.coalesce(1 - F.col("distance") / F.col("most"), F.lit(0.0)).alias("score"))
