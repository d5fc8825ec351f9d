"""Personal data: overlapping candidates, boosted trees over format and context, calibrated cuts.

All work on documents is native column expressions inside one projection: no shuffle, no
user function. Patterns are written so that matching is linear in the text.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Node, boost, calibrated_cut, scores
from .common import running

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
CONTEXT = 24

#: Base patterns: runs are possessive and start at their first character, or where the last match
#: ended, so that no run is scanned twice. They find what the plain patterns find.
BASE = (
    (EMAIL, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (IP, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    (CARD, r"[0-9](?:[\x20-]?+[0-9])++", ""),
    (PHONE, r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
#: High-recall generators for other spellings; their spans may overlap base spans and each other.
GENERATORS = (
    (EMAIL, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:[(\[{]\x20?(?i:at)\x20?[)\]}]|\x20at\x20)\x20?"
            r"[A-Za-z0-9-]{1,63}+(?:\x20?(?:[(\[{]\x20?(?i:dot)\x20?[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+){1,4}+"),
    (IP, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    (CARD, r"(?<![0-9A-Za-z])[0-9]{4,6}(?:[\x20./-]?[0-9]{3,6}){2,4}(?![0-9A-Za-z])"),
    (PHONE, r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])"),
)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CUES = (
    r"(?i)e-?mail|mailto|write to|contact|reach", r"(?i)\bip\b|host|server|address|ping",
    r"(?i)card|visa|master|amex|credit|debit|paid", r"(?i)phone|call|tel|mobile|fax|cell",
)
AGAINST = r"(?i)(?:order|invoice|isbn|serial|ref|tracking|version|batch|item|part|page)[\w#:.\x20]{0,8}$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, F.lit("[^0-9]+"), F.lit(""))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _valid(kind: int, text: Column) -> Column:
    """The check that a base match has to pass."""
    n = F.length(_digits(text))
    if kind == IP:
        return text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == CARD:
        return n.between(16, 19) & _luhn(_digits(text))
    if kind == PHONE:
        return n.between(8, 15)
    return F.lit(True)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _features(c: Column) -> list[Column]:
    """Integer format and context features of a candidate."""
    n = F.length(c.digits)
    cue = F.lit(False)
    for kind, pattern in enumerate(CUES):
        cue = F.when(c.kind == kind, c.before.rlike(pattern)).otherwise(cue)
    return [
        c.kind,
        F.least(n, F.lit(24)),
        _flag(F.when(n.between(12, 19), _luhn(c.digits))),
        _flag(c.text.rlike(r"^\([0-9]+\)")),
        F.length(F.regexp_replace(c.text, F.lit(r"[^\x20./-]+"), F.lit(""))),
        _flag(c.digits.rlike("^[3-6]")),
        _flag(cue),
        _flag(c.before.rlike(AGAINST)),
        _flag(c.text.rlike(r"[(\[{]\x20?(?i:at)\x20?[)\]}]")),
        _flag(c.text.rlike(r"(?i)(?:[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20)")),
        _flag(c.text.rlike(r"(?i)[.\x20](?:com|org|net|edu|gov|info|de|fr|es|uk|io)$")),
        _flag(c.after.rlike(r"^[A-Za-z0-9_]") | c.before.rlike(r"[A-Za-z0-9_]$")),
        _flag(c.text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
    ]


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns `doc` (struct of the input row), `text` (null as empty) and `found`: all candidates
    with kind, start, end (code points), text, digits, context and whether it is a base span.

    Base matches that fail their check are dropped, all matches of the generators stay. A text is a pattern's matches and the gaps between them, so running totals of their
    lengths give the places.
    """
    df = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast("array<string>")
    plan = [(kind, pattern, sign, True) for kind, pattern, sign in BASE]
    plan += [(kind, pattern, "", False) for kind, pattern in GENERATORS]
    df = df.select("*", *(
        F.when(text.contains(sign), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m{g}")
        for g, (_, pattern, sign, _) in enumerate(plan)))
    df = df.select("*", *(
        F.when(F.size(f"m{g}") > 0, F.split(text, plan[g][1], -1)).otherwise(none).alias(f"g{g}") for g in range(len(plan))))

    def total(g: int) -> Column:
        sizes = F.transform(f"m{g}", lambda m, i: (F.length(m) + F.length(F.get(F.col(f"g{g}"), i))).cast("long"))
        return running(sizes, F.lit(0).cast("long"), lambda a, x: a + x)

    df = df.select("*", *(total(g).alias(f"t{g}") for g in range(len(plan))))

    def spans(g: int, kind: int, base: bool) -> Column:
        gap = F.col(f"g{g}")

        def one(m: Column, i: Column) -> Column:
            start = F.get(F.col(f"t{g}"), i) + F.length(F.get(gap, i))
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"),
                m.alias("text"), _digits(m).alias("digits"),
                F.substring(F.get(gap, i), -CONTEXT, CONTEXT).alias("before"),
                F.substring(F.get(gap, i + 1), 1, CONTEXT).alias("after"),
                F.lit(base).alias("base"))

        found = F.transform(f"m{g}", one)
        return F.filter(found, lambda c: F.coalesce(_valid(kind, c.text), F.lit(False))) if base else found

    return df.select("doc", "text", F.concat(*(
        spans(g, kind, base) for g, (kind, _, _, base) in enumerate(plan))).alias("found"))


@dataclass(frozen=True)
class Model:
    """Trees, and for each kind the log-odds from which a candidate is redacted."""

    trees: tuple[Node, ...]
    cuts: tuple[float, ...]
    held_out: tuple[tuple[float, float], ...]

    def accepts(self, c: Column) -> Column:
        features = _features(c)
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + tree.column(features)
        cut = F.lit(float("inf"))
        for kind, least in enumerate(self.cuts):
            cut = F.when(c.kind == kind, F.lit(least)).otherwise(cut)
        return total >= cut


#: Rows of the labelled sample, half of them held out to set the cuts, and the precision asked of added spans.
SAMPLE_ROWS, PRECISION = 3000, 0.98


def labelled_sample(rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[int, str, int]]:
    """(row, text, label): personal data in spellings that base rules miss, and look-alikes.

    The corpus has no labels for spans, so the sample is written from format rules, with
    words of no meaning around it. A label holds for all candidates of its row.
    """
    rng = random.Random(seed)

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(n: int, good: bool) -> str:
        body = rng.choice("3456") + number(n - 2)
        total = sum((2 * int(d) - 9 * (d > "4")) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
        check = (-total) % 10
        return body + str(check if good else (check + rng.randint(1, 9)) % 10)

    def word() -> str:
        return "".join(rng.choice(("en", "ta", "ri", "os", "mel", "du", "an", "er")) for _ in range(rng.randint(1, 3)))

    def grouped(digits: str, sizes: tuple[int, ...], mark: str) -> str:
        ends = np.cumsum(sizes).tolist()
        return mark.join(digits[a:b] for a, b in zip([0, *ends], ends))

    def cue(*choices: str) -> str:
        return rng.choice(choices)

    def email(good: bool) -> str:
        if good:
            at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", "."), ("(at)", " dot ")))
            return cue("email ", "contact ", "", "") + word() + at + word() + dot + rng.choice(("com", "org", "net", "de", "fr"))
        return cue("", "look ", "we met ", "email ") + word() + " at " + word() + rng.choice((". ", ".", " . ")) + \
            rng.choice((word(), word(), "de", "es"))

    def ip(good: bool) -> str:
        if good:
            return cue("host ", "ip ", "server ", "", "") + ":".join(f"{rng.randrange(65536):x}" for _ in range(8))
        return cue("version ", "item ", "", "") + ".".join(str(rng.randint(256, 999)) for _ in range(4))

    def cards(good: bool) -> str:
        if not good and rng.random() < 0.3:
            return cue("token = ", "key ", "") + word()[:2] + card(rng.choice((13, 15, 16)), True) + rng.choice(("b7", "f", "_x"))
        n = rng.choice((13, 15, 15, 16, 16))
        sizes = {13: (4, 3, 3, 3), 15: (4, 6, 5), 16: (4, 4, 4, 4)}[n]
        mark = rng.choice((".", "/") if n == 16 and good else (" ", "-", ".", ""))
        return (cue("card ", "paid ") if good and not mark else cue("", "", "card ", "paid ")) + grouped(card(n, good), sizes, mark)

    def phone(good: bool) -> str:
        if good:
            a, b, c = number(3), number(3), number(4)
            return rng.choice((f"({a}) {b}-{c}", cue("call ", "tel ", "phone: ") + f"{a}-{b}-{c}", cue("mobile ", "fax ") + f"{a}.{b}.{c}",
                               cue("tel. ", "") + f"({a}) {b} {c}"))
        return rng.choice((cue("order ", "ref ", "invoice #", "") + f"{number(3)} {number(3)} {number(3)}",
                           cue("", "item ") + f"{number(2)}.{number(4)} {number(3)}", cue("isbn ") + f"{number(3)}-{number(4)}-{number(3)}",
                           cue("", "order ") + f"{number(3)}-{number(3)}-{number(4)}"))

    out = []
    for i in range(rows):
        good = rng.random() < 0.5
        core = (email, ip, cards, phone)[i % 4](good)
        out.append((i, f"{word()} {word()} {core} {word()} {word()}.", int(good)))
    return out


@lru_cache(maxsize=4)
def trained(rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> Model:
    """Train on the even half of the sample, set the cuts on the odd half.

    The sample is bounded by `rows`; its features come from the same expressions as those of documents.
    """
    spark = SparkSession.active()
    sample = spark.createDataFrame(labelled_sample(rows), "row long, text string, label int")
    rows = candidates(sample).select("doc.row", "doc.label", F.transform(
        F.filter("found", lambda c: ~c.base), lambda c: F.array(*_features(c))).alias("found")).collect()
    got = [(r.row, r.label, x) for r in rows for x in r.found]
    x, y = np.array([g[2] for g in got]), np.array([g[1] for g in got])
    held = np.array([g[0] // 4 % 2 for g in got]) == 1
    trees = boost(x[~held], y[~held])
    score = scores(trees, x)
    cuts, quality = [], []
    for kind in range(len(KINDS)):
        mine = held & (x[:, 0] == kind)
        cut = calibrated_cut(score[mine], y[mine], precision)
        chosen = mine & (score >= cut)
        cuts.append(cut)
        quality.append((float(y[chosen].mean()) if chosen.any() else 1.0, float(y[chosen].sum() / max(y[mine].sum(), 1))))
    return Model(tuple(trees), tuple(cuts), tuple(quality))


def find_pii(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Columns `doc` (struct of the input row), `text` and `spans`: array of
    (start, end, kind, base) in order of place; kind is the number in KINDS.

    Base spans always stay. An added span must reach its kind's cut and is left out where it
    overlaps a span before it or a base span after it. Null and empty texts have no spans;
    repeated rows get equal spans; other columns stay inside `doc`.
    """
    model = model or trained()
    long_zero = F.lit(0).cast("long")
    df = candidates(docs, text_col).select("doc", "text", F.sort_array(F.transform(
        F.filter("found", lambda c: c.base | model.accepts(c)),
        lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.kind.alias("kind"), c.base.alias("base")))).alias("all"))
    a = F.col("all")
    far = F.lit((1 << 62)).cast("long")
    df = df.select(
        "doc", "text", "all",
        running(F.transform(a, lambda s: s.end), long_zero, F.greatest).alias("before"),
        F.reverse(running(F.reverse(F.transform(a, lambda s: F.when(s.base, s.start).otherwise(far))), far, F.least)).alias("after"))
    keep = F.filter(a, lambda s, i: s.base | (
        (F.get(F.col("before"), i) <= s.start) & (F.get(F.col("after"), i) >= s.end)))
    return df.select("doc", "text", keep.alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of spans by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s.kind.alias("k"), s.start.alias("s"), s.end.alias("e"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.get(names, s.k), s.s.cast("string"), s.e.cast("string"))), ",")


#: Texts are cut by place in blocks of so many code points, so that a cut never walks a whole long text.
BLOCK = 4096


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The input rows with every span replaced by its kind in brackets; overlapping spans become one mark."""
    df = find_pii(docs, text_col, model)
    spans, blocks = F.col("spans"), F.col("blocks")
    df = df.select(
        "doc", "text", "spans",
        F.when(F.size(spans) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("blocks"),
        running(F.transform(spans, lambda s: s.end), F.lit(0).cast("long"), F.greatest).alias("done"))

    def cut(start: Column, end: Column) -> Column:
        first, last = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
        whole = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(whole, (start % BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def piece(s: Column, i: Column) -> Column:
        done = F.get(F.col("done"), i)
        return F.concat(cut(done, s.start), F.when(s.start >= done, F.get(marks, s.kind)).otherwise(""))

    stop = F.array_max(F.transform(spans, lambda s: s.end))
    size = F.length("text")
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""), cut(stop, size.cast("long"))))
    row = df.select("doc", clean.alias("clean"))
    names = docs.columns
    return row.select(*(
        F.coalesce(F.col("clean"), F.col("doc")[c]).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in names))
