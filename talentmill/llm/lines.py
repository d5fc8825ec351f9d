"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit when deleting one character from either (or from the longer
one only) gives the same string. So every line is posted under the hashes of its variants,
equal variants meet, and the earliest line of each meeting stays.

Exact copies are folded before. Variants are made only for lines that share one half with
another line of about the same length, in the other half: one edit leaves a half untouched,
so this loses no pair and spares the many lines without a near copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored

#: Lines of fewer characters are compared as they are: one edit is too much of them.
SHORT = 20
EDIT_BOUND = 1
#: Rolling hashes modulo two primes below 2^31, so that products fit 64 bits.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1869414811)
HAS_WORD = r"[^\x20\x09-\x0D]"


def _half_keys(line: Column, n: Column) -> list[Column]:
    """Hashes of the first and last half, for pairs whose longer line has n or n + 1 characters."""
    out = []
    for longer in (n, n + 1):
        half = (longer / 2).cast("int")
        rest = longer - 1 - half
        out.append(F.xxhash64(F.lit(0), longer, F.substring(line, F.lit(1), half)))
        out.append(F.xxhash64(F.lit(1), longer, F.substring(line, n - rest + 1, rest)))
    return out


@lru_cache(maxsize=8)
def _powers(which: int, size: int) -> np.ndarray:
    p, out = PRIMES[which], np.ones(1, np.int64)
    step = BASES[which]
    while len(out) < size:
        out = np.concatenate([out, out * pow(step, len(out), p) % p])
    return out


def deletion_hashes(line: str, low: bool, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the line itself (-1) and of its one-deletion variants in the wanted halves."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    n = len(c)
    at = np.arange(0 if low else n // 2, n if high else (n + 1) // 2)
    parts = []
    for which, p in enumerate(PRIMES):
        powers = _powers(which, 1 << n.bit_length())
        sums = np.concatenate([[0], np.cumsum(c * powers[:n] % p) % p])
        back = pow(BASES[which], -1, p)
        parts.append(np.concatenate([sums[n:], (sums[at] + (sums[n] - sums[at + 1]) % p * back) % p]))
    return np.concatenate([[-1], at]).astype(np.int32), parts[0] << 32 | parts[1]


def _variants(lines: DataFrame) -> DataFrame:
    """Variant hashes of candidate lines: hv, q (deleted position, -1 for the line itself), r."""
    bounded_batches(lines.sparkSession)
    schema = T.StructType([T.StructField("hv", T.LongType()), T.StructField("q", T.IntegerType()), T.StructField("r", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, todo = 0, []
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(1, 4))))
            for i, (line, low, high) in enumerate(rows):
                q, hv = deletion_hashes(line, low, high)
                todo.append((np.full(len(q), i), q, hv))
                size += len(q)
                if size > 500_000 or i == len(rows) - 1:
                    row, q, hv = (np.concatenate(x) for x in zip(*todo))
                    yield pa.RecordBatch.from_arrays([pa.array(hv), pa.array(q), batch.column(0).take(pa.array(row))], names=schema.names)
                    size, todo = 0, []

    return lines.select("r", "line", "low", "high").mapInArrow(run, schema)


def _row_key(key: Column, text: Column) -> Column:
    """Id and 128-bit hash of the text: equal copies of a row share it, other rows of the id, null too, do not."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(key.alias("id"), F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(1), text).alias("h1"))


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", short: int = SHORT) -> DataFrame:
    """Numbers of the lines that stay: d (id and hash of the text), kept (array of line numbers from 0).

    Order is (document id, hash of the text, line number); a null id comes first. A line goes if an earlier line
    of any document equals it, or is within one edit of it and both have `short` characters.
    Lines without a word are not compared.
    """
    source = docs.select(_row_key(docs[key], docs[text]).alias("d"), F.coalesce(docs[text], F.lit("")).alias("text"))
    line, n = F.col("line"), F.col("n")
    exploded = source.select("d", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(line.rlike(HAS_WORD))
    hashed = exploded.withColumn("n", F.length("line")).select(
        F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), "d", "p", "n",
        *(k.alias(f"k{i}") for i, k in enumerate(_half_keys(line, n))))
    firsts = stored(hashed.groupBy("a", "b").agg(
        F.min(F.struct("d", "p")).alias("at"), F.min("n").alias("n"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)),
    ).select("a", "b", "at.d", "at.p", "n", "k0", "k1", "k2", "k3"), "lines-first")

    long = firsts.where(n >= short)
    halves = long.select("a", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("side", "k"))
    shared = halves.groupBy("k").agg(F.count("*").alias("lines")).where("lines > 1").select("k")
    wanted = halves.join(shared, "k", "left_semi").groupBy("a").agg(
        F.max(F.col("side") % 2).alias("low"), F.min(F.col("side") % 2).alias("not_high"))
    per_doc = wanted.join(long.select("a", "d", "p"), "a").groupBy("d").agg(F.collect_list(F.struct(
        "p", "a", (F.col("low") == 1).alias("low"), (F.col("not_high") == 0).alias("high"))).alias("w")).withColumnRenamed("d", "wd")
    near = source.join(per_doc, F.col("d") == F.col("wd")).select(
        "d", F.split("text", "\n").alias("lines"), "w").select("d", "lines", F.explode("w").alias("w")).select(
        "d", "w.p", "w.a", "w.low", "w.high", F.get("lines", F.col("w.p")).alias("line"))
    # Equal copies of a row give their lines once; r numbers the lines in their order.
    near = near.where(F.xxhash64("line") == F.col("a")).distinct().sort("d", "p")
    near = stored(near.withColumn("r", F.monotonically_increasing_id()), "lines-near")

    me, is_self = F.col("r"), F.col("q") < 0
    group, place = Window.partitionBy("hv"), Window.partitionBy("hv", "q")
    met = _variants(near).select(
        "r", is_self.alias("self"), F.min(me).over(place).alias("peer"),
        F.min(F.when(is_self, me)).over(group).alias("whole"), F.min(F.when(~is_self, me)).over(group).alias("cut"))
    earlier = F.when(F.col("self"), F.col("cut")).otherwise(F.least("peer", "whole"))
    pairs = met.select("r", earlier.alias("e")).where(F.col("e") < me).groupBy("r").agg(F.min("e").alias("e"))
    left = near.select("r", F.col("d").alias("ld"), F.col("p").alias("lp"), F.col("a").alias("la"), F.col("line").alias("left"))
    right = near.select(F.col("r").alias("e"), F.col("line").alias("right"))
    gone = pairs.join(left, "r").join(right, "e").where(F.levenshtein("left", "right", EDIT_BOUND) >= 0).select("ld", "lp", "la")
    same = (F.col("d") == F.col("ld")) & (F.col("p") == F.col("lp")) & (F.col("a") == F.col("la"))
    return firsts.join(gone, same, "left_anti").groupBy("d").agg(F.collect_list("p").alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", short: int = SHORT) -> DataFrame:
    """Columns `doc` (struct of the input row), `kept_text`, `n_lines`, `n_removed`.

    `kept_text` is the lines that stay and the lines without a word, in their order. n_lines
    counts lines with a word. A null text has no line and gives the empty text. Rows of
    one id, null too, with different texts are documents each, in the order of a hash of the text; a
    repeated row is cleaned like its first copy. Any other columns stay inside `doc`; an empty table gives an empty result.
    """
    kept = kept_lines(docs, key, text, short)
    rows = docs.select(F.struct("*").alias("doc"))
    joined = rows.join(kept, _row_key(F.col("doc")[key], F.col("doc")[text]) == F.col("d"), "left")
    lines = F.split(F.coalesce(F.col("doc")[text], F.lit("")), "\n")
    blank = F.filter(F.transform(F.col("lines"), lambda x, i: F.when(~x.rlike(HAS_WORD), i)), lambda i: i.isNotNull())
    df = joined.select("doc", "kept", lines.alias("lines")).select("doc", "lines", blank.alias("blank"), F.coalesce(
        "kept", F.array().cast("array<int>")).alias("kept"))
    df = df.select("doc", "lines", "blank", "kept", F.sort_array(F.array_union("blank", "kept")).alias("stay"))
    n_lines, stay = F.size("lines") - F.size("blank"), F.col("stay")
    return df.select(
        "doc", F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n").alias("kept_text"),
        n_lines.cast("long").alias("n_lines"), (F.size("lines") - F.size(stay)).cast("long").alias("n_removed"))
