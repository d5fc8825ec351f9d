"""Substring dedup: per-shard compressed FM-indexes report what documents share.

A window of 13 words is removed where its words also start in a document of a smaller
id. Shards are by content: each window goes to the shard of its minimizer, the least hash
of the nine 5-word runs in it, so equal windows always meet and nothing else need be compared.
Only stretches whose minimizer occurs in two documents or more are sent at all. In a shard
equal stretches are folded to their first document; the rest is indexed, and the
windows of every stretch are searched backwards through the wavelet matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored
from .fmindex import FMIndex
from .shingles import mix, windows, word_hashes

WINDOW, RUN = 13, 5
#: Windows of one stretch at most, words of one index about.
STRETCH, INDEX_WORDS = 64, 400_000
#: Minimizers of more documents go window by window, each to the shard of its own hash: one shared passage has as many
#: different surroundings as documents, which a single shard could not hold.
HOT_DOCS = 20_000
#: An odd multiplier and its inverse modulo 2^64.
_STEP = np.uint64(0xA0761D6478BD642F)
_BACK = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))


def minimizers(words: np.ndarray, window: int) -> np.ndarray:
    """Least hash of the RUN-word runs in each window of words."""
    low = windows(words, RUN)
    span, width = window - RUN + 1, 1
    n = len(low) - span + 1
    if n <= 0:
        return low[:0].view(np.int64)
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[span - width:span - width + n]).view(np.int64)


def span_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of spans of words, equal for equal spans wherever they stand."""
    one = np.ones(1, np.uint64)
    powers = np.cumprod(np.append(one, np.full(len(words), _STEP)), dtype=np.uint64)
    backs = np.cumprod(np.append(one, np.full(len(words), _BACK)), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)])
    return mix((sums[stop] - sums[start]) * backs[start] + (stop - start).astype(np.uint64)).view(np.int64)


def _doc_minimizers(docs: DataFrame, window: int) -> DataFrame:
    """One row per document and distinct minimizer: m, id, key."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("m", T.LongType()), docs.schema["id"], T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(minimizers(w, window)) for w in word_hashes(batch.column(1).to_pylist())]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), batch.column(0).take(row), batch.column(2).take(row)], names=schema.names)

    return docs.select("id", "text", "key").mapInArrow(run, schema)


def _stretches(docs: DataFrame, window: int) -> DataFrame:
    """Stretches of windows with one shared minimizer: shard, h (hash of the words), id, key, start, codes."""
    bounded_batches(docs.sparkSession, rows=1000)
    longs = {c: T.StructField(c, T.LongType()) for c in ("shard", "h", "key")}
    schema = T.StructType([longs["shard"], longs["h"], docs.schema["id"], longs["key"],
                           T.StructField("start", T.IntegerType()), T.StructField("codes", T.BinaryType())])

    def of_doc(words: np.ndarray, shared: np.ndarray, hot: np.ndarray) -> tuple | None:
        least = minimizers(words, window)
        at = np.flatnonzero(np.isin(least, shared))
        if not len(at):
            return None
        is_hot = np.isin(least[at], hot)
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(least[at]) != 0) | is_hot[1:]])
        run_start = np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.flatnonzero((np.arange(len(at)) - run_start) % STRETCH == 0)
        start, stop = at[first], at[np.append(first[1:], len(at)) - 1] + window
        shard = np.where(is_hot[first], windows(words, window).view(np.int64)[start], least[start])
        codes = (words >> np.uint64(32)).astype("<u4").tobytes()
        parts = [codes[a:b] for a, b in zip((4 * start).tolist(), (4 * stop).tolist())]
        return shard, span_hashes(words, start, stop), start, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shared, hot = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            held, size, hashes = [], 0, word_hashes(texts)
            for i, words in enumerate(hashes):
                found = of_doc(words, shared[i].values.to_numpy(), hot[i].values.to_numpy())
                if found:
                    held.append((np.full(len(found[0]), i), *found))
                    size += len(found[0])
                if held and (size > 100_000 or i == len(hashes) - 1):
                    i_, shard, h, start = (np.concatenate(x) for x in list(zip(*held))[:4])
                    row = pa.array(i_)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard), pa.array(h), batch.column(0).take(row), batch.column(4).take(row),
                        pa.array(start.astype(np.int32)), pa.array([c for x in held for c in x[4]], pa.binary())], names=schema.names)
                    held, size = [], 0

    return docs.mapInArrow(run, schema)


def search_shard(codes: list[np.ndarray], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each stretch, which of its windows occur in a stretch of a smaller document number.

    The stretches are indexed together, divided by a symbol of their own, and streamed against the index.
    """
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes)
    stretch = np.repeat(np.arange(len(codes)), sizes)
    symbols = np.unique(flat, return_inverse=True)[1] + 2
    place = np.arange(len(flat)) + stretch
    text = np.ones(len(flat) + len(codes) + 1, np.int64)
    text[place] = symbols
    text[-1] = 0
    owner = np.full(len(text), len(codes))
    owner[place] = stretch
    index = FMIndex(text)
    ends = np.concatenate([np.arange(s + window - 1, s + n) for s, n in zip(np.cumsum(sizes) - sizes + np.arange(len(codes)), sizes)])
    out = np.zeros(len(ends), bool)
    alive, lo, hi = index.matches(text, ends, window)
    if len(alive):
        number = np.append(docs, np.iinfo(np.int64).max)[owner[index.order]]
        bounds = np.unique(lo)
        tops = hi[np.unique(lo, return_index=True)[1]]
        least = np.minimum.reduceat(np.append(number, np.iinfo(np.int64).max), np.stack([bounds, tops], 1).reshape(-1))[::2]
        out[alive] = least[np.searchsorted(bounds, lo)] < docs[owner[ends[alive]]]
    return np.split(out, np.cumsum(sizes - window + 1)[:-1])


def _searched(folded: DataFrame, window: int) -> DataFrame:
    """h, and as bytes which windows of the stretch also start in a document before its first one."""
    bounded_batches(folded.sparkSession, rows=20000)
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("first", folded.schema["first"].dataType),
                           T.StructField("earlier", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def search() -> pa.RecordBatch:
            _, h, first, codes = zip(*held)
            # Documents by rank: ids of any type that sorts will do.
            order = {x: i for i, x in enumerate(sorted(set(first)))}
            flags = search_shard([np.frombuffer(c, "<u4") for c in codes], np.array([order[x] for x in first]), window)
            return pa.RecordBatch.from_arrays([
                pa.array(h, pa.int64()), pa.array(first, kind), pa.array([f.astype(np.uint8).tobytes() for f in flags], pa.binary())],
                names=schema.names)

        for batch in batches:
            kind = batch.schema.field(2).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= INDEX_WORDS and row[0] != held[-1][0]:
                    yield search()
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // 4
        if held:
            yield search()

    return folded.mapInArrow(run, schema)


def _removed(docs: DataFrame, window: int) -> DataFrame:
    """id, key and their marks: (start, windows, earlier); null `earlier` means every window of the stretch.

    Equal rows of one id share their key, so what is gathered for them is gathered once (as a set).
    """
    mins = _doc_minimizers(docs.where("id is not null"), window)
    shared = mins.groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("docs")) \
        .where("lo < hi").select("m", (F.col("docs") > HOT_DOCS).alias("hot"))
    per_doc = mins.join(shared, "m").groupBy("id", "key").agg(
        F.collect_set("m").alias("shared"), F.collect_set(F.when(F.col("hot"), F.col("m"))).alias("hot"))
    parts = stored(_stretches(docs.join(per_doc, ["id", "key"]).select("id", "text", "shared", "hot", "key"), window), "substring-stretches")

    folded = parts.groupBy("shard", "h").agg(F.min("id").alias("first"), F.min("codes").alias("codes"))
    alone = folded.repartition("shard").sortWithinPartitions("shard")
    found = stored(_searched(alone.select("shard", "h", "first", "codes"), window), "substring-found")
    marks = parts.select("h", "id", "key", "start", (F.octet_length("codes") / 4 - (window - 1)).cast("int").alias("windows")).join(
        found.select("h", "first", "earlier", F.regexp_count(F.hex("earlier"), F.lit("01")).alias("hits")), "h")
    mine = F.col("id") == F.col("first")
    return marks.where(~mine | (F.col("hits") > 0)).groupBy("id", "key").agg(F.collect_set(
        F.struct("start", "windows", F.when(mine, F.col("earlier")).alias("earlier"))).alias("marks"))


def drop_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns: the key, n_words, n_removed, kept_text (the words that stay, joined by one space).

    A word goes if a window over it also starts in a document of a smaller id; windows are judged on
    the input. Null, empty and blank texts have no words. A row with a null id is neither
    searched nor a reason to remove anything. Rows that share an id never remove
    each other's words. Stretches carry 32 bits per word, so a wrong match needs 13 words that agree in
    those. Other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(docs[key].alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("key"))
    rows = source.join(_removed(source, window), ["id", "key"], "left").select("id", "text", "marks")
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            marked = batch.column(2)
            start, windows_, earlier = (marked.flatten().field(c) for c in range(3))
            start, windows_, whole = start.to_numpy(), windows_.to_numpy(), earlier.is_null().to_numpy(zero_copy_only=False)
            edges = np.append(0, np.cumsum(np.nan_to_num(marked.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            counts, gone, kept = [], [], []
            for t, lo, hi in zip(texts, edges.tolist(), edges[1:].tolist()):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                counts.append(len(words))
                if hi > lo:
                    cover = np.zeros(len(words) + 1, np.int64)
                    full = lo + np.flatnonzero(whole[lo:hi])
                    # All windows of a stretch cover it without a gap.
                    np.add.at(cover, start[full], 1)
                    np.add.at(cover, start[full] + windows_[full] - 1 + window, -1)
                    for k in (lo + np.flatnonzero(~whole[lo:hi])).tolist():
                        at = np.flatnonzero(np.frombuffer(earlier[k].as_buffer(), np.uint8)) + start[k]
                        cover[at] += 1
                        cover[at + window] -= 1
                    words = list(compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
