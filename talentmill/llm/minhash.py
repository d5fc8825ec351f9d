"""Near duplicates by a signature-coordinate inverted join.

A document with J = 0.75 to another agrees with it in each of 32 MinHash coordinates with
probability 0.75, and in fewer than 11 with probability 2.4e-7. Pairs that agree in at least
11 share a value among any 22 of the coordinates. So each document is posted only under
22 coordinate-value pairs, the rarest: the frequent ones, up to ten, are skipped. Values that only
one document has take places in that prefix and need no posting at all.

Within a long posting list documents are not paired with each other but with one pivot, the
document whose values are the most frequent: that joins a group of copies. Long lists whose
documents then still belong to several components mostly share a passage, not their text. Their documents are
posted once more, under the rarest quarter of their whole shingle sets, which a similar pair must
share as well and a mere passage does not reach; ranks in that order bound what two sets can share.
All pairs that reach the match count are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored
from .components import components
from .shingles import mix, shingle_set, word_hashes

WIDTH = 5
PERCENT = 75
COORDINATES, MATCHES = 32, 11
PREFIX = COORDINATES - MATCHES + 1
#: Lists of up to so many documents are paired in full.
SHORT_LIST = 16
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash coordinates of non-empty sets, one row each."""
    flat, out = np.concatenate(sets), np.empty((len(sets), COORDINATES), np.uint64)
    first = np.cumsum([0, *map(len, sets[:-1])])
    for k, seed in enumerate(_SEEDS):
        out[:, k] = np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), first)
    return out


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """id, n (set size), s0 and s1 (128 bits that name the set), tokens (hashed coordinate-value pairs)."""
    bounded_batches(docs.sparkSession)
    longs = (T.StructField(c, T.LongType()) for c in ("n", "s0", "s1"))
    schema = T.StructType([docs.schema["id"], *longs, T.StructField("tokens", T.ArrayType(T.LongType()))])
    places = mix(np.arange(COORDINATES, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w, width) for w in word_hashes(batch.column(1).to_pylist(), lower=True)]
            n = np.array([len(s) for s in sets], np.int64)
            s0 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            s1 = np.array([np.bitwise_xor.reduce(mix(s ^ _SEEDS[0])) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            tokens = np.zeros((0, COORDINATES), np.uint64)
            if n.any():
                tokens = mix(signatures([s for s in sets if len(s)]) ^ places)
            ends = np.cumsum(np.concatenate([[0], (n > 0) * COORDINATES])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s0), pa.array(s1), lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, shingles: the whole sorted shingle set of each document."""
    bounded_batches(docs.sparkSession, rows=500)
    schema = T.StructType([docs.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w, width) for w in word_hashes(batch.column(1).to_pylist(), lower=True)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def _similar(pairs: DataFrame, tokens: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that reach the match count and whose full sets are similar."""
    left, right = tokens.toDF("u", "tu"), tokens.toDF("v", "tv")
    agree = F.size(F.filter(F.zip_with("tu", "tv", lambda x, y: x == y), lambda same: same))
    likely = pairs.join(left, "u").join(right, "v").where(agree >= MATCHES).select("u", "v")
    left, right = sets.toDF("u", "su"), sets.toDF("v", "sv")
    common = F.size(F.array_intersect("su", "sv"))
    return likely.join(left, "u").join(right, "v").where(
        100 * common >= percent * (F.size("su") + F.size("sv") - common)).select("u", "v")


def _lists(posted: DataFrame, room: Column, length: Column, purpose: str) -> DataFrame:
    """Posting lists of the rarest tokens of each document: token, node, length, rank, size, pivot.

    A document is posted under its first `room` of `length` tokens, rarest first. Tokens that it has alone
    take places but need no list. The pivot is the document whose tokens are the most frequent.
    """
    keyed = posted.select("node", "token", room.cast("int").alias("room"), length.cast("int").alias("length"))
    often = keyed.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    ranked = keyed.join(often, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("docs", "token"))).alias("t"), F.sum("docs").alias("central"),
        F.max("room").alias("room"), F.max("length").alias("length"))
    places = F.size("t") + F.col("room") - F.col("length")
    prefix = stored(ranked.where(places > 0).select(
        "node", "central", "length", (F.col("length") - F.size("t")).alias("alone"),
        F.posexplode(F.slice("t", F.lit(1), places)).alias("at", "t")).select(
        "node", "central", "length", (F.col("alone") + F.col("at")).alias("rank"), F.col("t.token").alias("token")), purpose)
    pivots = prefix.groupBy("token").agg(F.count("*").alias("size"), F.max(F.struct("central", "node")).alias("p")) \
        .where("size > 1").select("token", "size", F.col("p.node").alias("pivot"))
    return stored(prefix.select("node", "token", "length", "rank").join(pivots, "token"), purpose)


def _first_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of short lists, and the pairs of long lists with their pivot."""
    short = lists.where(F.col("size") <= SHORT_LIST)
    pairs = short.select("token", F.col("node").alias("u")).join(short.select("token", F.col("node").alias("v")), "token")
    star = lists.where(F.col("size") > SHORT_LIST).select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
    return pairs.select("u", "v").union(star).where("u < v").distinct()


def _unsettled(lists: DataFrame, label: DataFrame) -> DataFrame:
    """Members of long lists that hold documents of more than one component, with their label."""
    rows = lists.where(F.col("size") > SHORT_LIST).join(label.toDF("node", "label"), "node", "left") \
        .select("token", "node", "length", "rank", F.coalesce("label", "node").alias("label"))
    rows = stored(rows, "minhash-labels")
    mixed = rows.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
    return rows.join(mixed, "token", "left_semi")


def _rest_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in lists of whole-set shingles that can still be similar.

    Ranks bound the overlap: with a first common shingle at ranks i and j, no more than
    1 + min(n_u - i - 1, n_v - j - 1) shingles are common, and similar sets need
    percent * (n_u + n_v) / (100 + percent). The smaller set of a pair needs to be listed under fewer shingles.
    """
    x, y = (members.toDF(*(c if c == "token" else f"{c}_{side}" for c in members.columns)) for side in "xy")
    need = percent * (F.col("length_x") + F.col("length_y"))
    bound = (100 + percent) * F.least(F.col("length_x") - F.col("rank_x"), F.col("length_y") - F.col("rank_y"))
    small = x.where((100 + percent) * (F.col("length_x") - F.col("rank_x")) >= 2 * percent * F.col("length_x"))
    ordered = F.struct("length_x", "node_x") < F.struct("length_y", "node_y")
    pairs = small.join(y, (x["token"] == y["token"]) & ordered & (F.col("label_x") != F.col("label_y")) & (bound >= need))
    return pairs.select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                    percent: int = PERCENT) -> DataFrame:
    """Columns `doc` (struct of the input row), n_shingles, component_id, kept.

    Components link documents whose sets of `width`-word shingles (A-Z lower-cased; a shorter
    text is one shingle) have 100 * intersection >= percent * union. component_id is
    the smallest id in reach, kept is id = component_id. Null, empty and blank texts have no
    shingle and are linked with nothing. A row without an id cannot name a component:
    its component_id is null and it stays. Rows that share an id count as one document, so a
    repeated row is kept with its first copy. Other columns stay inside `doc`.
    """
    source = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    sketch = stored(_sketches(source, width), "minhash-sketch")
    the_set = ("n", "s0", "s1")
    folded = sketch.where("n > 0 and id is not null").groupBy(*the_set).agg(
        F.min("id").alias("node"), F.first("tokens").alias("tokens"))
    folded = stored(folded, "minhash-fold")
    tokens = folded.select("node", "tokens")

    lists = _lists(tokens.select("node", F.explode("tokens").alias("token")), F.lit(PREFIX), F.lit(COORDINATES), "minhash-lists")
    wanted = lists.select(F.col("node").alias("id")).distinct()
    sets = stored(_full_sets(source.join(wanted, "id", "left_semi"), width), "minhash-sets")
    links = stored(_similar(_first_pairs(lists), tokens, sets, percent), "minhash-links")

    left = _unsettled(lists, components(links)).select(F.col("node").alias("id")).distinct()
    shingles = sets.join(left, "id", "left_semi").select(
        F.col("id").alias("node"), F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    room = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    lists = _lists(shingles, room, F.col("n"), "minhash-sets-lists")
    links = stored(links.union(_similar(_first_pairs(lists), tokens, sets, percent)), "minhash-links")
    named = _unsettled(lists, components(links))
    links = links.union(_similar(_rest_pairs(named, percent), tokens, sets, percent))

    label = components(links).toDF("node", "component")
    named = folded.select(*the_set, "node").join(label, "node", "left").select(
        *(F.col(c).alias(f"f_{c}") for c in the_set), F.coalesce("component", "node").alias("component"))
    same = [F.col(c) == F.col(f"f_{c}") for c in the_set]
    per_doc = sketch.select("id", *the_set).join(named, same, "left").groupBy("id").agg(
        F.min(F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component"))).alias("component"), F.max("n").alias("n"))
    per_doc = per_doc.select(F.col("id").alias("node_id"), "n", F.coalesce("component", "id").alias("component_id"))
    return _with_rows(docs, key, per_doc)


def _with_rows(docs: DataFrame, key: str, per_doc: DataFrame) -> DataFrame:
    row: Column = F.col("doc")[key]
    joined = docs.select(F.struct("*").alias("doc")).join(per_doc, row.eqNullSafe(F.col("node_id")), "left")
    return joined.select("doc", F.col("n").alias("n_shingles"), "component_id",
                         F.coalesce(row == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows without near copies of an earlier id: one document of each group stays."""
    return near_duplicates(docs, key, text).where("kept").select("doc.*")
