"""Divergence audit, spelling variants and language identification against plain re-computations."""

from __future__ import annotations

import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from talentmill.llm import divergence, langid, spelling  # noqa: E402
from talentmill.llm.divergence import source_divergence  # noqa: E402
from talentmill.llm.langid import identify_language, ranked, gram_counts, words_in  # noqa: E402
from talentmill.llm.spelling import near_words, spelling_variants  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n long, term string, key string, word string, block int"
EXTRA = (7, "x", "y", "z", 3)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


# --- divergence -----------------------------------------------------------------------------

def plain_divergence(rows, least_docs, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        counts[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        of = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(of.values(), Counter())
        def chance(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: chance(c) for s, c in of.items()}, chance(whole)
        for s, c in of.items():
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in of if o != s]
            own = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(own)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


ROWS = [
    (1, "The cat sat on the mat, Émile!", "en", "a"), (2, "the dog_sat on THE log", "en", "b"), (3, None, "en", "c"), (4, "", "en", None),
    (5, "le chat est là", "fr", "a"), (6, "le chien est là-bas", "fr", "b"), (7, "the cat", None, "a"), (8, "the dog", None, None),
    (1, "The cat sat on the mat, Émile!", "en", "a"), (9, "日本 语 cat", "en", "é"), (None, "cat cat cat", "en", "z"), (10, "solo", "xx", "only"),
]


@pytest.mark.parametrize("least, group_block, term_block", [(1, 32, 4096), (2, 1, 2), (99, 32, 4096)])
def test_divergence_equals_plain_computation(spark, monkeypatch, least, group_block, term_block):
    monkeypatch.setattr(divergence, "GROUP_BLOCK", group_block)
    monkeypatch.setattr(divergence, "TERM_BLOCK", term_block)
    got = {tuple(r) for r in source_divergence(table(spark, ROWS), least_docs=least, top=3).collect()}
    assert got == plain_divergence(ROWS, least, 3)


def test_divergence_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 1)
    batches = list(divergence._count(iter(
        table(spark, [(i, t, x, s) for i, t, x, s in ROWS if t and x and s]).select("lang", "source", "text").toArrow().to_batches())))
    total = Counter()
    for b in batches:
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in b.columns)):
            total[lang, source, term] += n
    assert total["en", "a", "the"] == 4 and total["fr", "b", "bas"] == 1 and len(batches) > 5


def test_divergence_of_an_empty_table(spark):
    assert source_divergence(table(spark, [])).collect() == []


# --- spelling -------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, least_length, least_count, deleted):
    n = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % deleted == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


WORDS = ("letters " * 12 + "Leters leters leters leter leter lettres lettrés lettrés ÉCOLE école ecole ecole ecole écoles écoles écoles écolés "
         "abcde abcdé abcde abcd aaaaa aaaaaa aaaaaaa aaaaaa aaaaaa aaaaaaa ×÷×÷× ×÷×÷× tests_tests tests-tests 123tests日本tests ")


@pytest.mark.parametrize("deleted", [97, 3, 1])
def test_variants_equal_plain_computation(spark, deleted):
    rows = [(1, WORDS, "en", "a"), (2, WORDS * 3, "en", "a"), (2, WORDS * 3, "en", "a"), (None, "letters abcde", "en", "b"), (3, None, None, None), (4, "", "", "")]
    rows += [(i, "wxyz" * 3 + "q" * (i % 7) + " " + "anagrams nagarams " * (i % 3), "en", "a") for i in range(5, 60)]
    got = [tuple(r) for r in spelling_variants(table(spark, rows), least_count=2, deleted=deleted).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(rows, 5, 2, deleted)
    assert any(r[1] and r[2] != r[1] for r in got) or deleted != 3


def test_near_words_loses_no_pair_and_finds_no_other(spark):
    words = sorted({a + b + c for a in ("abc", "acb", "ébc", "ab", "") for b in ("xyz", "xy", "yxz", "xÿz") for c in ("mno", "mnno", "omn", "mo")})
    got = {(r.a, r.b) for r in near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


@settings(max_examples=200, deadline=None)
@given(st.text("abcdé", min_size=5, max_size=12), st.integers(0, 99), st.sampled_from("abcdéz"), st.sampled_from(("insert", "delete", "replace")))
def test_one_edit_leaves_a_signature(word, at, letter, kind):
    import pyarrow as pa
    at %= len(word)
    other = {"insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1:], "replace": word[:at] + letter + word[at + 1:]}[kind]
    rows = next(spelling._signatures(iter([pa.RecordBatch.from_arrays([pa.array([word, other]), pa.array([1, 1])], names=["word", "n"])])))
    keys = rows.column(0).to_pylist()
    half = len(keys) // 2
    assert set(keys[:half]) & set(keys[half:])


def test_variants_of_an_empty_table(spark):
    assert spelling_variants(table(spark, [])).collect() == []


def test_signatures_and_links_are_never_broadcast(spark):
    # Small tables, which Spark broadcasts by their size unless it is told not to.
    words = spark.createDataFrame([("letters", 9), ("lettres", 3), ("leters", 3)], "word string, n long")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "word string, root string")
    docs = table(spark, [(1, WORDS * 3, "en", "a")])
    for found, rows in ((near_words(words), 1), (spelling._roots(links), 3), (spelling_variants(docs), None)):
        assert len(found.collect()) == rows or rows is None
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    written = []
    keep, spelling.stored = spelling.stored, lambda df, purpose: (written.append(df), keep(df, purpose))[1]
    try:
        spelling_variants(docs).collect()
    finally:
        spelling.stored = keep
    for df in written:
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


# --- language -------------------------------------------------------------------------------

def plain_languages(rows):
    fold = lambda key: zlib.crc32(("" if key is None else str(key)).encode()) % langid.FOLDS == langid.HELD_OUT
    learned = defaultdict(Counter)
    for key, text, lang, _ in rows:
        if not fold(key) and lang is not None:
            learned[lang] += gram_counts(Counter(words_in(text)))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in learned.items() if c}
    out = []
    for key, text, *_ in rows:
        grams = ranked(gram_counts(Counter(words_in(text))))
        best = min(((sum(abs(i - p[g]) if g in p else langid.PROFILE for i, g in enumerate(grams)), lang) for lang, p in profiles.items()), default=None)
        known = best and grams
        out.append((key, fold(key), best[1] if known else "und", 1 - best[0] / (langid.PROFILE * len(grams)) if known else 0.0))
    return sorted(out, key=str)


TEXTS = [(i, t, x, None) for i, (t, x) in enumerate([
    ("the weather is fine and the children are playing in the garden", "en"), ("das Wetter ist schön und die Kinder spielen im Garten", "de"),
    ("le temps est beau et les enfants jouent dans le jardin", "fr"), ("there is nothing that they would rather have than this", "en"),
    ("es gibt nichts, was sie lieber hätten als dieses", "de"), ("il n'y a rien qu'ils aimeraient mieux avoir que cela", "fr"),
    (None, "en"), ("", "fr"), ("12 ½ ²³ _ !", "de"), ("ⅧⅨ а б", None), ("the garden", None), ("x" * 5000, "zz"), ("und", "en"),
] * 4)] + [(1, "le jardin", "fr", None)] * 2 + [(None, "der Garten", "de", "s")]


@pytest.mark.parametrize("languages", [256, 1])
def test_language_equals_plain_computation(spark, monkeypatch, languages):
    monkeypatch.setattr(langid, "LANGUAGES", languages)
    rows = identify_language(table(spark, TEXTS)).collect()
    assert sorted(map(tuple, rows), key=str) == plain_languages(TEXTS)
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_are_runs_of_letters():
    assert words_in("Écoles n°5 ½x Ⅷy snake_case") == ["écoles", "n", "x", "y", "snake", "case"]
    assert words_in(None) == words_in("²³ 12") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abé_ \n1½Ⅷİ日本"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=4), st.booleans())
def test_windows_count_what_words_count(texts, dense):
    from unittest import mock
    texts = [t.lower() for t in texts if langid.quick(t.lower())]
    with mock.patch.object(langid, "DENSE", langid.DENSE if dense else 0):
        packed, counts = langid.gram_matrix(texts) if texts else ([], [])
    for text, row in zip(texts, counts):
        assert {langid.unpacked(int(g)): n for g, n in zip(packed, row) if n} == gram_counts(Counter("".join(c if c.isalpha() else " " for c in text).split()))


def test_letters_beyond_16_bits_are_counted_word_by_word(spark):
    rows = [(0, "the 𐐨𐐩 garden 😀 is", "en", None), (3, "𐐨𐐩𐐨𐐩 𐐨𐐩", "xx", None), (2, "𐐨𐐩", None, None), (4, "the garden", "en", None)]
    assert sorted(map(tuple, identify_language(table(spark, rows)).collect()), key=str) == plain_languages(rows)


def test_language_without_anything_learned(spark):
    assert [tuple(r) for r in identify_language(table(spark, [(1, "text", None, None)])).collect()] == [(1, zlib.crc32(b"1") % 3 == 1, "und", 0.0)]
    assert identify_language(table(spark, [])).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in identify_language(docs).collect() if r.held_out]
    right = sum(truth[r.doc_id] == r.lang_pred for r in held)
    print(f"held-out accuracy {right}/{len(held)}")
    assert right >= math.floor(0.97 * len(held)) and len(held) > 200
