"""Resume and job-text rules as native column expressions (no Python UDF)."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(text, F.lit(vocab.WS_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty or white-space-only text."""
    return text.isNull() | ~text.rlike(f"[^{vocab.WS}]")


def words(lowered: Column) -> Column:
    """The word tokens of a lower-cased text (with an empty string at most at the ends)."""
    return F.split(lowered, f"[^{vocab.WORD}]+")


def extract_email(text: Column) -> Column:
    """First e-mail address, lower-cased, or null."""
    hit = F.regexp_extract(text, vocab.EMAIL, 0)
    return F.when(text.contains("@"), F.lower(F.nullif(hit, F.lit(""))))


def extract_phone(text: Column) -> Column:
    """First phone number in US notation, trimmed, or null."""
    hit = F.regexp_extract(text, vocab.PHONE, 0)
    return F.when(text.rlike(vocab.PHONE_TAIL), strip(F.nullif(hit, F.lit(""))))


def extract_name(text: Column) -> Column:
    """First of the first five lines made of 2 to 4 alphabetic words, or null."""
    head = F.slice(F.split(text, "\n", 6), 1, 5)
    lines = F.transform(head, strip)
    return F.get(F.filter(lines, lambda line: line.rlike(vocab.NAME_LINE)), 0)


def title_case(raw: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(raw, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def _constant(value: object, kind: str) -> Column:
    """A constant of a nested type, folded once by the optimizer.

    One call instead of one per element keeps the plan quick to build.
    """
    return F.from_json(F.lit(json.dumps(value)), kind)


def normalise_skill(raw: Column) -> Column:
    """Alias label of a free-form skill, else the skill in title case."""
    alias = F.element_at(_constant(vocab.SKILL_ALIASES, "map<string,string>"), strip(F.lower(raw)))
    return F.coalesce(alias, title_case(raw))


def vocabulary_hits(lowered: Column) -> Column:
    """The distinct tokens of a lower-cased text that occur in the skill vocabulary.

    One hashed pass over the tokens, whatever the size of the vocabulary.
    """
    known = sorted({w for term in vocab.skill_terms() for w in vocab.components(term)})
    return F.array_intersect(words(lowered), _constant(known, "array<string>"))


def extract_skills(lowered: Column, hits: Column) -> Column:
    """Sorted distinct skill labels found in a lower-cased text, given its vocabulary hits.

    A one-word term is found if it is a hit. A term with spaces or symbols is tested by
    its own regex, and only if all its words are hits; a single alternation would
    consume overlapping terms. The terms are one constant array, which keeps the
    generated code small enough for the JVM to compile.
    """
    terms = vocab.skill_terms()
    single = {t: label for t, label in terms.items() if vocab.is_word(t)}
    labels = _constant(single, "map<string,string>")
    phrases = _constant(
        [
            {"words": vocab.components(t), "pattern": vocab.bounded(t), "label": label}
            for t, label in terms.items() if t not in single
        ],
        "array<struct<words:array<string>,pattern:string,label:string>>",
    )

    def found(p: Column) -> Column:
        has_all = F.forall(p["words"], lambda w: F.array_contains(hits, w))
        return F.when(has_all, F.rlike(lowered, p["pattern"])).otherwise(F.lit(False))

    from_words = F.transform(hits, lambda w: F.element_at(labels, w))
    from_phrases = F.transform(F.filter(phrases, found), lambda p: p["label"])
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(from_words, from_phrases))))


def extract_yoe(text: Column, as_of_year: int) -> Column:
    """Years of experience as of a given year.

    Year ranges are kept in document order; a range that overlaps a kept one is
    dropped whole. Without any counted year, a stated "N years of experience"
    counts; else 0.
    """
    found = F.regexp_extract_all(text, F.lit(vocab.YEAR_RANGE), F.lit(0))

    def span(match: Column) -> Column:
        end = F.lower(F.regexp_extract(match, r"(?i)([0-9]{4}|[a-z]+)$", 1))
        return F.struct(
            F.regexp_extract(match, r"([0-9]{4})", 1).cast("int").alias("first"),
            F.when(end.isin(*vocab.OPEN_ENDED), F.lit(as_of_year))
            .otherwise(end.try_cast("int")).alias("last"),
        )

    def plausible(s: Column) -> Column:
        return (
            s["first"].between(vocab.FIRST_YEAR, as_of_year)
            & (s["first"] <= s["last"])
            & (s["last"] <= as_of_year + 1)
        )

    def take(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: (s["last"] > k["first"]) & (s["first"] < k["last"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    spans = F.filter(F.transform(found, span), plausible)
    none = F.array().cast("array<struct<first:int,last:int>>")
    years = F.aggregate(
        F.aggregate(spans, none, take),
        F.lit(0),
        lambda total, s: total + s["last"] - s["first"],
    )
    stated = F.regexp_extract(text, vocab.YEARS_STATED, 1).try_cast("double")
    counted = F.get(F.filter(F.array(years), lambda y: y > 0), 0)  # folds the ranges once
    return F.coalesce(counted.cast("double"), stated, F.lit(0.0))


def extract_visa(lowered: Column) -> Column:
    """Visa status by keyword substring in fixed priority, else 'unknown'."""
    status = F  # chain of F.when(...).when(...)
    for name in vocab.VISA_PRIORITY:
        keywords = _constant(vocab.VISA_KEYWORDS[name], "array<string>")
        hit = F.exists(keywords, lambda k: F.contains(lowered, k))
        status = status.when(hit, F.lit(name))
    return status.otherwise(F.lit("unknown"))


def truncate_at_sentence(text: Column, max_chars: int = 4000) -> Column:
    """Cut a text to max_chars, after its last full stop if that lies in the last fifth."""
    head = F.substring(text, 1, max_chars)
    back = F.instr(F.reverse(head), ".")  # 1-based from the end, 0 if absent
    last_stop = max_chars - back  # 0-based from the start
    at_stop = F.substring(head, F.lit(1), last_stop + 1)
    cut = F.when((back > 0) & (last_stop > max_chars * 0.8), at_stop).otherwise(head)
    return F.when(F.length(text) <= max_chars, text).otherwise(cut)


def _present(value: Column) -> Column:
    return value.isNotNull() & (value != F.lit(""))


def _head(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def candidate_embed_text(
    resume_text: Column, skills: Column, location: Column, visa: Column, yoe: Column,
    max_chars: int | None = None,
) -> Column:
    """Text that represents a candidate in embeddings; empty parts are left out.

    The whole resume counts; an encoder with an input limit passes max_chars.
    """
    return F.concat_ws(
        "\n",
        F.when(_present(resume_text), _head(resume_text, max_chars)),
        F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(skills, ", "))),
        F.when(_present(location), F.concat(F.lit("Location: "), location)),
        F.when(_present(visa), F.concat(F.lit("Visa: "), visa)),
        F.when(yoe != 0, F.concat(F.lit("Years of experience: "), yoe.cast("string"))),
    )


def job_embed_text(
    title: Column, jd_text: Column, skills: Column, location: Column, min_yoe: Column,
    max_chars: int | None = None,
) -> Column:
    """Text that represents a job in embeddings; empty parts are left out."""
    return F.concat_ws(
        "\n",
        F.when(_present(title), F.concat(F.lit("Job title: "), title)),
        F.when(_present(jd_text), _head(jd_text, max_chars)),
        F.when(F.size(skills) > 0, F.concat(F.lit("Required skills: "), F.array_join(skills, ", "))),
        F.when(_present(location), F.concat(F.lit("Location: "), location)),
        F.when(
            min_yoe != 0,
            F.concat(F.lit("Minimum experience: "), min_yoe.cast("string"), F.lit(" years")),
        ),
    )


def safe_filename(filename: Column, stamp: Column) -> Column:
    """Replace unsafe characters and put a time stamp in front."""
    clean = F.regexp_replace(filename, r"[^A-Za-z0-9_.\-]", "_")
    return F.concat_ws("_", F.date_format(stamp, "yyyyMMdd_HHmmss"), clean)


def file_type(path: Column) -> Column:
    """Lower-case extension of a path, or an empty string."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def decoder_route(extension: Column) -> Column:
    """Which decoder a file type goes to: 'pdf', 'docx' or null if unsupported."""
    ext = F.ltrim(F.lower(extension), F.lit("."))
    return F.when(ext == "pdf", F.lit("pdf")).when(ext.isin("docx", "doc"), F.lit("docx"))
