"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talentmill.llm import bpe, packing, pii, search
from talentmill.llm.boosting import boost, calibrated_cut, scores
from talentmill.llm.chat import rotate_perspectives
from talentmill.llm.common import stored
from talentmill.llm.components import components
from talentmill.llm.fmindex import FMIndex, suffix_array
from talentmill.llm.lines import dedup_lines
from talentmill.llm.minhash import drop_near_duplicates, near_duplicates
from talentmill.llm.quality import keep_good, quality_rules
from talentmill.llm.search import top_documents
from talentmill.llm.sharding import assign_shards, write_shards
from talentmill.llm.substrings import drop_repeated_windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_words long, kept string, shard string"


def table(spark, texts):
    """Documents with extra columns whose names operators also use."""
    rows = [(i, t, 7, "x", None) if not isinstance(t, tuple) else (*t, 7, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


# Quality rules


def test_quality_counts_and_edges(spark):
    good = " ".join(f"the rule{chr(97 + i % 26)}{chr(97 + i // 26)} word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(30)) + "."
    texts = [None, "", " \n\t", "a b c a b c\n#x\n#x\n", good, "The " * 80, good.replace(" ", "%%% ")]
    got = {r.doc.doc_id: r for r in quality_rules(table(spark, texts)).collect()}
    assert [got[i].n_words for i in range(4)] == [0, 0, 0, 8]
    assert (got[3].n_repeat_words, got[3].n_dup_lines, got[3].n_symbols, got[3].word_chars) == (6, 1, 2, 10)
    assert got[4].kept and not got[4].failed
    assert got[5].base_failed and got[5].n_repeat_words == 80
    assert not got[6].base_failed and "symbols_per_word" in got[6].failed
    kept = keep_good(table(spark, texts + [(4, good)]))
    assert [r.doc_id for r in kept.collect()] == [4, 4] and kept.columns == table(spark, []).columns
    assert quality_rules(table(spark, [])).count() == 0


# Line dedup


def brute_lines(texts):
    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 20 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    before, out = [], []
    for t in texts:
        stay, n, gone = [], 0, 0
        for line in (t or "").split("\n"):
            if not re.search(r"[^\x20\x09-\x0D]", line):
                stay.append(line)
                continue
            n += 1
            if any(near(line, x) for x in before):
                gone += 1
            else:
                stay.append(line)
            before.append(line)
        out.append(("\n".join(stay), n, gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    base = ["the quick brown fox jumps over", "aaaaaaaaaaaaaaaaaaaaaaaaa", "señor él niño año mañana 🎉 ok yes", "short line", "abababababababababababab"]

    def edit(s):
        at, c = rng.randrange(len(s) + 1), rng.choice("abé ")
        return rng.choice((s, s[:at] + c + s[at:], s[:at] + s[at + 1:], s[:at] + c + s[at + 1:]))

    texts = ["\n".join(rng.choice((edit(rng.choice(base)), edit(edit(rng.choice(base))), "", "  ")) for _ in range(rng.randrange(6)))
             for _ in range(60)] + [None, "", "x" * 50_000, "x" * 50_001, "y" + "x" * 50_000]
    got = {r.doc.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in dedup_lines(table(spark, texts)).collect()}
    for i, want in enumerate(brute_lines(texts)):
        assert got[i] == want, (i, texts[i][:200] if texts[i] else None)


def test_line_dedup_of_odd_tables(spark):
    assert dedup_lines(table(spark, [])).count() == 0
    rows = [(1, "a long enough line of text"), (None, "a long enough line of text"), (1, "a long enough line of text"), (2, None)]
    got = sorted((r.doc.doc_id or -1, r.kept_text) for r in dedup_lines(table(spark, rows)).collect())
    assert got == [(-1, "a long enough line of text"), (1, ""), (1, ""), (2, "")]


def test_line_dedup_of_different_texts_of_one_id(spark):
    same = [f"the {w} line stands in all of them" for w in ("first", "second", "third")]
    rows = [(key, "\n".join(["own", f"text of {key} and {i}"] + same[i % 3:] + same[:i % 3])) for key in (None, 5) for i in range(12)] * 2
    rows += [(5, "an edited line of text, one"), (5, "an edited line of text, one!")]
    got = dedup_lines(table(spark, rows)).collect()
    text_of = {(r.doc.doc_id, r.doc.text): r.kept_text for r in got}
    assert len(got) == 50 and len(text_of) == 26
    stay = [x for t in text_of.values() for x in t.split("\n") if x]
    assert sorted(x for x in stay if x in same) == sorted(same) and stay.count("own") == 1
    assert sum(x.startswith("an edited") for x in stay) == 1
    assert all((r.doc.doc_id, r.kept_text) == (r.doc.doc_id, text_of[r.doc.doc_id, r.doc.text]) for r in got)


# Personal data


def plain_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if holds(k, m[0])]


@pytest.fixture(scope="module")
def pii_texts():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x-1", ".", "1.2.3.4", "999.1.2.3", "4465758382889437", "4465 7583 8288 9437", "+1 (663) 555-6869", "+", "12",
             " ", "\n", "_", "%", "é", "🎉", "00012.1.1.1", "a@b.co", "a@b@c.d", "a@b.co_x@d.com", "5", "-"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(600)] + [
        None, "", "a." * 20_000 + "@" + "b." * 20_000, "a@b.co,1.2.3.4 " * 2000, "1" * 50_000]


def test_base_spans_and_redaction_equal_brute_force(spark, pii_texts):
    docs = table(spark, pii_texts)
    found = {r.id: [(pii.KINDS[s.kind], s.start, s.end, s.base) for s in r.spans]
             for r in pii.find_pii(docs).select(F.col("doc.doc_id").alias("id"), "spans").collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, text in enumerate(pii_texts):
        text = text or ""
        assert sorted(s[:3] for s in found[i] if s[3]) == sorted(plain_spans(text))
        want, at = "", 0
        for kind, start, end, _ in found[i]:
            want += text[at:start] + f"[{kind.upper()}]" if start >= at else ""
            at = max(at, end)
        assert (clean[i] or "") == want + text[at:]
    assert pii.redact(docs).columns == docs.columns and pii.redact(table(spark, [])).count() == 0


def test_model_adds_other_spellings_and_leaves_look_alikes(spark):
    texts = ["write to bob (at) site (dot) com now", "call (555) 123-4567 today", "card 3782 822463 10005 paid", "host 2001:db8:0:0:0:0:0:1 up",
             "we met at noon. Then left", "order 555 123 456 came", "token = ab4465758382889438cd", "number 4465758382889438 failed"]
    got = {r.id: [pii.KINDS[s.kind] for s in r.spans] for r in pii.find_pii(table(spark, texts)).select(
        F.col("doc.doc_id").alias("id"), "spans").collect()}
    assert [got[i] for i in range(8)] == [["email"], ["phone"], ["card"], ["ip"], [], [], [], []]


def test_model_reaches_its_precision_on_held_out_rows(spark):
    model = pii.trained()
    assert all(precision >= pii.PRECISION for precision, _ in model.held_out)
    assert all(recall >= 0.4 for _, recall in model.held_out)


def test_boosting_and_cut():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (400, 3))
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(int)
    score = scores(boost(x, y), x)
    assert ((score > 0) == y).mean() > 0.98
    assert calibrated_cut(np.array([3.0, 2, 1, 0]), np.array([1, 1, 0, 0]), 0.9) == 2.0
    assert calibrated_cut(np.array([1.0, 0]), np.array([0, 0]), 0.9) == float("inf")


# Byte-pair encoding and packing


def odd_texts():
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'t", "é", "ß", "中", "🎉", "1", "23", "...", "<|endoftext|>", " ", "\x1c", "\x85", "the",
             "I'll", "​", "x" * 70, "ab" * 80, "\r\n", "٣", "Ⅷ", "_", "."]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500)] + [
        None, "", "a" * 3000, " " * 500, "the" * 2000, "\n" * 300]


def test_encoding_equals_the_tokenizer(spark):
    coder, texts = Tokenizer.from_file(PATH), odd_texts()
    got = {r.doc_id: r for r in bpe.encode(table(spark, texts), PATH, decoded=True).collect()}
    for i, text in enumerate(texts):
        ids = coder.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded == coder.decode(ids, skip_special_tokens=False)
    back = bpe.decode(spark.createDataFrame([(1, bytearray(got[0].ids)), (2, None)], "k int, ids binary"), PATH).collect()
    assert [r.decoded for r in back] == [texts[0], ""]
    assert bpe.encode(table(spark, []), PATH).count() == 0


def test_differencing_balances():
    rng = random.Random(2)
    sizes = [rng.randint(1, 300) for _ in range(200)]
    groups = packing.differencing(sizes, 8)
    assert sorted(i for g in groups for i in g) == list(range(200))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 4
    assert len(packing.balanced_windows([60, 60, 60], 100)) == 3
    assert packing.balanced_windows([], 100) == []


def test_packing_odd_tables(spark):
    docs = table(spark, [None, "", "a b c " * 3000, (None, "word"), (2, "again")])
    rows = packing.pack(docs, PATH, window=64).collect()
    assert sum(r.length for r in rows if r.doc_id == 0) == 1
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert len(r.ids) == 4 * r.length
    assert max(fill.values()) <= 64
    assert packing.pack(table(spark, []), PATH).count() == 0


# Near duplicates


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_texts():
    texts = []
    for family in range(12):
        base = words(rng_size := 60 + family, family)
        texts.append(" ".join(base))
        for copy in range(8):
            edited = list(base)
            for at in random.Random(family * 100 + copy).sample(range(rng_size), copy % 4):
                edited[at] = f"new{family}{copy}{at}"
            texts.append(" ".join(edited).upper() if copy == 0 else " ".join(edited))
    passage = " ".join(words(55, 999))
    texts += [" ".join(words(45, 2000 + i)) + " " + passage for i in range(40)]
    return texts + [None, "", " ", "one two", "One  two", "one two three", " ".join(words(30_000, 5))]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = {r.doc.doc_id: r for r in near_duplicates(table(spark, texts)).collect()}
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), label[i], label[i] == i), i


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    text = " ".join(words(30, 1))
    docs = table(spark, [(5, text), (5, text), (None, text), (3, text), (9, None)])
    got = sorted((r.doc.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert drop_near_duplicates(docs).columns == docs.columns


# Sharding


def test_shards_fit_and_only_large_ones_split(spark):
    docs = table(spark, ["x" * (i % 50) for i in range(3000)] + [None, (None, "y")] + [(4, "z" * 30)] * 500)
    rows = assign_shards(docs, limit=2000).collect()
    assert len(rows) == docs.count()
    size = {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        assert len(r.shard) == r.depth
    assert all(r.shard_bytes == size[r.shard] for r in rows) and max(size.values()) <= 2000
    for shard in size:
        assert not any(shard != s and s.startswith(shard) for s in size)
        parent = sum(n for s, n in size.items() if s.startswith(shard[:-1]))
        assert parent > 2000
    assert [r.shard for r in assign_shards(table(spark, ["x" * 99]), limit=10).collect()] == [""]
    assert assign_shards(table(spark, []), limit=10).count() == 0


def test_shards_are_written_as_folders(spark, tmp_path):
    docs = table(spark, ["text" * 20 for _ in range(50)])
    write_shards(docs, str(tmp_path / "out"), limit=1500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and set(docs.columns) < set(back.columns)


# Substring dedup


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = FMIndex(text)
    assert suffix_array(text).tolist() == sorted(range(301), key=lambda i: text[i:].tolist())
    ends = np.arange(3, 300)
    alive, lo, hi = index.matches(text, ends, 4)
    count = {e: h - n for e, n, h in zip(ends[alive].tolist(), lo.tolist(), hi.tolist())}
    for e in ends.tolist():
        times = sum(np.array_equal(text[i:i + 4], text[e - 3:e + 1]) for i in range(297))
        assert count.get(e, 1) == max(times, 1)


def brute_windows(rows, width=13):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    for (key, _), w in zip(rows, split):
        for i in range(len(w) - width + 1):
            gram = tuple(w[i:i + width])
            first[gram] = min(first.get(gram, key), key)
    out = []
    for (key, _), w in zip(rows, split):
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i:i + width])] < key for j in range(i, i + width)}
        out.append((key, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr("talentmill.llm.substrings.HOT_DOCS", hot)
    rng = random.Random(8)
    passages = [words(n, n) for n in (12, 13, 14, 40, 90)] + [["the"] * 30]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += words(rng.randrange(20), rng.random()) + rng.choice(passages)[rng.randrange(5):]
        rows.append((i, "\n".join(w)))
    rows += [(70, None), (71, ""), (72, rows[0][1]), (72, rows[1][1] + " " + " ".join(passages[4])), (73, " ".join(words(20_000, 1)))]
    got = drop_repeated_windows(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_windows(rows)


def test_repeated_windows_of_odd_tables(spark):
    assert drop_repeated_windows(table(spark, [])).count() == 0
    text = " ".join(words(20, 1))
    got = drop_repeated_windows(table(spark, [(None, text), (4, text), (4, text), (3, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (3, 0), (4, 20), (4, 20)]


# Search


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("talentmill.llm.search.SHARD_DOCS", 70)
    monkeypatch.setattr("talentmill.llm.search.BLOCK_DOCS", 8)
    monkeypatch.setattr("talentmill.llm.search.QUERY_WORDS", 200)
    rng = random.Random(6)
    vocabulary = [f"t{int(rng.paretovariate(0.8))}" for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "T1 t1 T1"]
    texts += texts[:20]
    docs = table(spark, texts)
    got = {}
    for r in top_documents(docs, docs.where("doc_id % 10 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    bags = [re.findall(r"\S+", (t or "").lower()) for t in texts]
    n, mean = len(texts), sum(map(len, bags)) / len(texts)
    df = {}
    for bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    for q in range(0, len(texts), 10):
        score = {}
        for d, bag in enumerate(bags):
            total = sum(bags[q].count(t) * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bag.count(t) * 2.2
                        / (bag.count(t) + 1.2 * (0.25 + 0.75 * len(bag) / mean)) for t in set(bags[q]) & set(bag))
            if total and d != q:
                score[d] = round(total, 6)
        want = sorted(score, key=lambda d: (-score[d], d))[:5]
        assert [d for _, d, _ in sorted(got.get(q, []))] == want
    assert top_documents(table(spark, []), table(spark, [])).count() == 0


@pytest.mark.parametrize("common", [0, 3, 512])
def test_search_scores_a_batch_of_queries_like_brute_force(monkeypatch, common):
    monkeypatch.setattr(search, "COMMON_WORDS", common)
    monkeypatch.setattr(search, "BLOCK_DOCS", 16)
    monkeypatch.setattr(search, "BATCH_POSTINGS", 50)
    draw = np.random.default_rng(7)
    words = [np.minimum(draw.geometric(0.02, draw.integers(0, 60)), 400).astype(np.uint64) for _ in range(210)]
    rank, index = search._build(words)
    asked = [np.unique(w, return_counts=True) for w in words[:40]]
    terms, place = np.unique(np.concatenate([t for t, _ in asked]), return_inverse=True)
    spans, times = np.cumsum([0, *(len(t) for t, _ in asked)]), np.concatenate([n for _, n in asked]).astype(float)
    idf, mean = 1 + terms / 400.0, float(np.mean([len(w) for w in words]))
    tf = np.array([[np.sum(words[d] == t) for t in terms] for d in rank], float)
    length = search.K1 * (1 - search.B + search.B * index["lengths"] / mean)
    impact = tf * (search.K1 + 1) / (tf + length[:, None]) * idf
    least = np.where(np.arange(40) % 3 == 0, 20.0, -np.inf)
    own = ([q for q in range(0, 40, 2)], [int(np.flatnonzero(rank == q)[0]) for q in range(0, 40, 2)])
    before = least.copy()
    query, doc, score = search._Shard(index, terms, idf, mean).top(spans, place, times, least, 5, own)
    assert (least == before).all()
    for q in range(40):
        span = slice(spans[q], spans[q + 1])
        full = impact[:, place[span]] @ times[span]
        want = sorted(((-round(x, 6), d) for d, x in enumerate(full) if x > 0 and (q, d) not in zip(*own) and round(x, 6) >= least[q]))[:5]
        got = sorted(zip((-score[query == q]).tolist(), doc[query == q].tolist()))
        assert [d for _, d in got[:5]] == [d for _, d in want] and np.allclose([x for x, _ in got[:5]], [x for x, _ in want], atol=2e-6)
        # Nothing below the k-th score is returned.
        assert all(x <= got[:5][-1][0] for x, _ in got)


def test_search_keeps_a_file_per_shard(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 20)
    docs = table(spark, [(i, f"word{i % 9} other{i}") for i in range(100)]).coalesce(1)
    index = stored(search.build_index(docs.select(F.col("doc_id").alias("id"), "text")), "search-index", maxRecordsPerFile=1)
    assert index.count() == len(index.inputFiles()) == 5


def test_search_leaves_out_every_row_of_the_own_id(spark):
    rows = [(0, "alpha beta gamma")] * 12 + [(0, "alpha beta delta")] * 3 + [(i, "alpha beta" + " pad" * i) for i in range(1, 9)]
    docs = table(spark, rows).coalesce(1)
    got = top_documents(docs, docs.where("doc_id = 0"), k=5).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 6)]


# Chat


def test_every_participant_becomes_the_assistant(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 3, "ann", None),
            (2, 0, None, "x"), (3, 0, "system", "alone"), (None, 0, "cy", "z"), (1, None, "bob", "late")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(r.conv_id, r.perspective, r.part): r for r in rotate_perspectives(turns).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", -1), (1, "bob", -1), (2, "unknown", 0), (None, "cy", 0)}
    ann = got[1, "ann", 0]
    assert ann.rendered == ("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n"
                            "<|user name=bob|>\nyo<|end|>\n<|assistant|>\n<|end|>\n")
    trained = [ann.rendered[slice(*map(int, s.split(":")))] for s in ann.loss_spans.split(",")]
    assert trained == ["hi<|end|>\n", "<|end|>\n"] and ann.n_loss_chars == sum(map(len, trained)) and ann.n_turns == 4
    assert got[1, "ann", -1].loss_spans == ""
    long = spark.createDataFrame([(1, i, "ab"[i % 2], str(i)) for i in range(700)], "conv_id long, turn long, role string, text string")
    assert sorted((r.perspective, r.part, r.n_turns) for r in rotate_perspectives(long).collect())[:3] == [("a", 0, 256), ("a", 1, 256), ("a", 2, 188)]
    assert rotate_perspectives(long.limit(0)).count() == 0


def test_parts_of_hot_turns_are_cut_by_row(spark):
    rows = [(None, None, "ab"[i % 2], f"{i:04}") for i in range(70)] + [(None, 3, "ab"[i % 2], f"{i:04}") for i in range(50)]
    rows += [(7, 1000 * i, "ab"[i % 2], f"{i:04}") for i in range(25)] + [(8, 5, "a", "x")]
    turns = spark.createDataFrame(rows + rows[:30], "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.part): r for r in rotate_perspectives(turns, part_turns=20).collect() if r.perspective == "a"}
    sizes = {k: r.n_turns for k, r in got.items()}
    assert sizes == {(None, -1): 20, (None, -2): 20, (None, -3): 20, (None, -4): 10, (None, 0): 20, (None, 1): 20, (None, 2): 10,
                     (7, 0): 20, (7, 1): 5, (8, 0): 1}

    def own(conv, parts):
        return [t for p in parts for t in re.findall(r"\n(\d{4})<", got[conv, p].rendered)[-sizes[conv, p]:]]

    assert own(7, [0, 1]) == [f"{i:04}" for i in range(25)]
    by_speaker = sorted((f"{i:04}" for i in range(70)), key=lambda t: (int(t) % 2, t))
    assert own(None, [-1, -2, -3, -4]) == by_speaker and own(None, [0, 1, 2]) == [t for t in by_speaker if int(t) < 50]


def test_later_parts_have_the_system_turns_and_context(spark):
    rows = [(1, 0, "system", "be kind"), *((1, i, "ab"[i % 2], f"t{i}") for i in range(1, 600)), (1, 300, "system", "be brief"),
            (1, 310, "system", "be kind"), (1, None, "system", "no names"), (1, None, "b", "late")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    numbered = sorted(r[1:] for r in rows if r[1] is not None)
    loose = [(None, "b", "late"), (None, "system", "no names")]

    def want(me, system, context, own):
        text, spans = "", []
        for i, (_, role, words) in enumerate([*system, *context, *own]):
            text += {"system": "<|system|>", me: "<|assistant|>"}.get(role, f"<|user name={role}|>") + "\n"
            start = len(text)
            text += words + "<|end|>\n"
            if role == me and i >= len(system) + len(context):
                spans.append((start, len(text)))
        return len(own), text, ",".join(f"{a}:{b}" for a, b in spans), sum(b - a for a, b in spans)

    kind, brief, names = numbered[0], (300, "system", "be brief"), loose[1]
    again = (310, "system", "be kind")
    got = {(r.perspective, r.part): tuple(r)[3:] for r in rotate_perspectives(turns).collect()}
    assert len(got) == 8
    for me in "ab":
        assert got[me, 0] == want(me, [names], [], numbered[:256])
        assert got[me, 1] == want(me, [names, kind], numbered[224:256], numbered[256:512])
        assert got[me, 2] == want(me, [names, brief, again], numbered[480:512], numbered[512:])
        assert got[me, -1] == want(me, [brief, again], [], loose)
    some = {(r.perspective, r.part): tuple(r)[3:] for r in rotate_perspectives(turns, part_turns=4, context_turns=10).collect()}
    assert some["a", 50] == want("a", [names, kind], numbered[190:200], numbered[200:204])
    short = turns.where("turn < 20 and role <> 'a'")
    assert {r.part for r in rotate_perspectives(short, context_turns=300).collect()} == {0}
