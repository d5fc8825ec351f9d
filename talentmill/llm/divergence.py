"""How far the sources of a language differ in their use of words, by three-dimensional cube partitioning.

Counts of kept terms form a matrix of groups (lang, source) by terms. Both axes are hashed into
blocks of bounded size. A task owns a cell (group block, group block, term block): it receives the
slices of both group blocks, replicated to every cell that needs them, and adds up the divergence of
each pair of groups over its terms. Partial sums are then reduced along the term axis.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Expected groups of a group block and terms of a term block.
GROUP_BLOCK, TERM_BLOCK = 32, 4096
#: Terms held by a counting task before it hands its counts on.
HELD = 200_000
#: Probabilities are whole multiples of one in so many.
SCALE = 1_000_000_000

#: Letters A-Z become small; all bytes that are no part of a term become spaces.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, source, text to sums per term; an empty term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [b"", *n]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *(docs[t] for t in n)], pa.int64()),
            ], names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms, before = text.as_py().translate(_TERM_BYTES).split(), len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def _probability(count: str, total: str) -> str:
    """1 + floor(SCALE * (count + 2) / total), in decimals so that no count overflows."""
    return f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div cast({total} as decimal(20, 0))"


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell; `covered` counts its terms that any of its groups has."""
    lang, low, high, _ = (k.as_py() for k in key)
    # In the same order in every cell, so that a pair has the same left side along the term axis.
    rows = rows.sort_by("source")
    sources = rows["source"].to_pylist()
    block = rows["block"].to_numpy()
    terms = [np.asarray(t.values) for t in rows["terms"]]
    empty = rows["empty"].to_numpy()
    columns = np.unique(np.concatenate([*terms, np.zeros(0, np.int32)]))
    p = np.repeat(empty[:, None], len(columns), 1)
    for i, (t, values) in enumerate(zip(terms, rows["ps"])):
        p[i, np.searchsorted(columns, t)] = np.asarray(values.values)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out: dict[str, list] = {c: [] for c in ("left", "right", "part", "base")}
    for k, i in enumerate(left):
        others = left[k + 1:] if low == high else right
        d = p[i] - p[others]
        e = empty[i] - empty[others]
        out["left"] += [sources[i]] * len(others)
        out["right"] += [sources[j] for j in others]
        out["part"] += (d * d // (p[i] + p[others])).sum(1).tolist()
        out["base"] += (e * e // (empty[i] + empty[others])).tolist()
    n = len(out["left"])
    kept = rows["kept"][0].as_py() if n else 0
    return pa.table([
        pa.array([lang] * n, pa.string()), pa.array(out["left"], pa.string()), pa.array(out["right"], pa.string()),
        pa.array(out["part"], pa.int64()), pa.array([len(columns)] * n, pa.int64()),
        pa.array(out["base"], pa.int64()), pa.array([kept] * n, pa.int64()),
    ], names=["lang", "left", "right", "part", "covered", "base", "kept"])


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      least_docs: int = 10, top: int = 10) -> DataFrame:
    """Columns lang, source, part, item, value, rank: how each group (lang, source) differs from the others and from its language.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps those in at least
    `least_docs` of its rows. With count occurrences in a group (or language), N of all kept terms there and V kept
    terms, p = 1 + floor(1e9 * (count + 2) / (N + 2V)); two distributions differ at a term by
    f = floor((p - q)^2 / (p + q)). Part `pair` sums f over all kept terms for each other source of the language (0
    where nothing is kept). Part `term` lists the `top` terms that the group has and uses more than its language.
    Ranks go by value, greatest first, then by item in UTF-8 order. All arithmetic is exact.

    Null texts, languages and sources read as ''. Every group that occurs is compared, also without terms.
    Repeated rows count each time; the order of rows does not matter. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    blank = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    counted = docs.select(*blank).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    groups = counts.where("term = ''").select("lang", "source")

    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = stored(terms.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "divergence-terms")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(
        terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = stored(langs.na.fill(0, ["kept", "lang_total"]).select(
        "lang", "kept", (F.col("lang_total") + 2 * F.col("kept")).alias("lang_total"),
        F.ceil(F.col("n_groups") / GROUP_BLOCK).alias("group_blocks"),
        F.greatest(F.ceil(F.col("kept") / TERM_BLOCK), F.lit(1)).alias("term_blocks")), "divergence-langs")

    # Kept terms get a number within their block; a block is bounded, so the window is.
    numbered = terms.join(langs.select("lang", "term_blocks"), "lang").withColumn(
        "term_block", F.pmod(F.xxhash64("term"), "term_blocks")).withColumn(
        "number", F.row_number().over(Window.partitionBy("lang", "term_block").orderBy("term"))).drop("term_blocks")
    cells = counts.join(numbered, ["lang", "term"]).select(
        "lang", "source", "term_block", F.struct("number", "n", "lang_n", "term").alias("cell"))
    # Every group has a slice in every term block, if an empty one: its pairs need it there.
    anchors = groups.join(langs, "lang").select(
        "lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("term_block"),
        F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"))
    # A slice is what one group has in one term block: at most as many cells as the block has terms.
    slices = cells.union(anchors).groupBy("lang", "source", "term_block").agg(F.collect_list("cell").alias("cells"))
    slices = stored(slices, "divergence-slices")
    totals = slices.groupBy("lang", "source").agg(
        F.sum(F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c.n)).alias("total"))
    totals = totals.join(langs, "lang").withColumn("total", F.col("total") + 2 * F.col("kept"))
    slices = slices.join(totals, ["lang", "source"])

    cube = slices.select(
        "lang", "source", "term_block", "kept", F.pmod(F.xxhash64("source"), "group_blocks").alias("block"),
        F.col("cells.number").alias("terms"), F.expr(f"transform(cells, c -> {_probability('c.n', 'total')})").alias("ps"),
        F.expr(f"if(kept = 0, 1, {_probability('0', 'total')})").alias("empty"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1)).alias("other"),
    ).select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    partial = cube.groupBy("lang", "low", "high", "term_block").applyInArrow(
        _cell, "lang string, left string, right string, part long, covered long, base long, kept long")
    # Terms that neither group has are not in any cell's columns: each adds the same amount.
    pairs = partial.groupBy("lang", "left", "right", "base", "kept").agg(F.sum("part").alias("part"), F.sum("covered").alias("covered"))
    pairs = pairs.select("lang", (F.col("part") + (F.col("kept") - F.col("covered")) * F.col("base")).alias("value"), F.explode(F.array(
        F.struct(F.col("left").alias("source"), F.col("right").alias("item")),
        F.struct(F.col("right").alias("source"), F.col("left").alias("item")))).alias("of"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value").withColumn("rank", F.row_number().over(order))

    used = slices.select("lang", "source", "total", "lang_total", F.explode("cells").alias("c")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("c.term").alias("item"),
        F.expr(_probability("c.n", "total")).alias("p"), F.expr(_probability("c.lang_n", "lang_total")).alias("q"))
    used = used.where("p > q").select(
        "lang", "source", "part", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    used = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.union(used)
