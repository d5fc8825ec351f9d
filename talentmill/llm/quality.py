"""Quality rules: a threshold table compiled into one projection of text ratios.

Every figure is a native column expression over the whole text: no shuffle, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, where_last, words_of

SYMBOLS = "[#*$%&|<>]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "de la que el en y los se las del un por con no su una para es al lo "
    "le et les des du une pour est par dans qui avec pas sur au "
    "der die und den von zu das mit sich auf für ist im nicht dem ein eine als"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where its figure lies outside [least, most]; a null figure passes."""

    name: str
    figure: str
    least: float | None = None
    most: float | None = None


#: The method's own rules. Counts are exact; ratios are per word, per line or per letter.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("exclamations_per_word", "n_exclamations / n_words", None, 0.25),
    Rule("capitals_per_letter", "n_capitals / n_letters", None, 0.5),
    Rule("letters_per_char", "n_letters / word_chars", 0.6, None),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.04, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.45),
    Rule("repeated_word_ratio", "n_repeat_words / n_words", None, 0.45),
)


def _repeat_words(words: str) -> list[tuple[str, Column]]:
    """Stages that count the words lying in 3-word windows found at least twice.

    Windows are sorted as packed longs (32 bits of hash, 32 of position); only windows
    whose hash bits repeat are compared as strings, so the count is exact. Repeated
    windows in position order cover min(3, gap to the next one) words each.
    """
    w = F.col(words)
    packed = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        .bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(i.cast("long")),
    )
    s = F.col("_packed")

    def twin(a: Column, i: Column, at: int) -> Column:
        return F.coalesce(F.shiftright(a, 32) == F.shiftright(F.get(s, i + at), 32), F.lit(False))

    hits = F.filter(s, lambda v, i: twin(v, i, -1) | twin(v, i, 1))
    as_text = F.sort_array(F.transform(F.col("_hits"), lambda v: _window(w, v.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))))
    t = F.col("_texts")

    def same(x: Column, i: Column, at: int) -> Column:
        return F.coalesce(x.w == F.get(t, i + at).w, F.lit(False))

    found = F.sort_array(F.transform(F.filter(t, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x.at))
    p = F.col("_found")
    cover = F.transform(p, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - at, F.lit(3))))
    total = F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)
    return [("_packed", F.sort_array(packed)), ("_hits", hits), ("_texts", as_text), ("_found", found),
            ("n_repeat_words", total)]


def _window(words: Column, at: Column) -> Column:
    parts = F.struct(*(F.get(words, at + k).alias(f"w{k}") for k in range(3)))
    return F.struct(parts.alias("w"), at.alias("at"))


def text_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that rules use: columns `doc` (the input row) and the figures.

    Null, empty and blank texts count zero everywhere.
    """
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    df = docs.select(F.struct("*").alias("doc")).select(
        "doc", words_of(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(text, F.lit(r"\P{L}+"), F.lit(""))).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, F.lit(SPACE_CLASS + "+"), F.lit(""))).cast("long").alias("word_chars"),
    ).withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
    })
    for name, value in _repeat_words("_words"):
        df = df.withColumn(name, value)
    return df.drop("_words", "_lines", "_packed", "_hits", "_texts", "_found")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of figures fails, compiled from the table."""
    checks = []
    for rule in rules:
        x = F.try_divide(*(F.col(c.strip()) for c in rule.figure.split("/"))) if "/" in rule.figure else F.col(rule.figure)
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (x < rule.least)
        if rule.most is not None:
            bad = bad | (x > rule.most)
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule.name)))
    return F.array_compact(F.array(*checks))


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Figures, failed rules and verdict per document.

    Columns: `doc` (struct of the whole input row, so no column name can clash), the
    figures, `base_failed`, `failed` (rule names) and `kept`. Rows are judged one by one:
    repeated rows get equal verdicts, an empty table an empty result.
    """
    return text_figures(docs, text_col).withColumns({
        "base_failed": base_failed(),
        "failed": failed_rules(rules),
    }).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input rows that pass, with the input's columns."""
    return where_last(quality_rules(docs, text_col, rules), "kept").select("doc.*")
