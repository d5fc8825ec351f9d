"""Exact BM25 top-k by block maxima over per-shard inverted indexes, without the pivots of WAND.

The corpus is cut into shards of documents, each with an inverted index whose posting lists
are divided into blocks of neighbouring documents with their greatest impact. Document
counts are global, so scores of all shards agree and the merge is exact. Queries
run in blocks of bounded size: one pass collects the counts of their words, one scores.
Within a shard, batches of similar queries take their rare words from the posting lists; the words that many of
its documents have are bounded by block maxima, and only documents that reach a query's k-th score are scored in full.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored
from .shingles import word_hashes

K1, B = 1.2, 0.75
TOP = 10
#: Documents of a shard and of a block within it; words of a shard at most, but for one long document.
SHARD_DOCS, BLOCK_DOCS, SHARD_WORDS = 4096, 64, 3_000_000
#: A word is common in a shard if it is in this part of its documents; at most so many, the commonest, form a dense matrix (16 MB).
COMMON_PART, COMMON_WORDS = 16, 512
#: Queries, and postings of their rare words, that are scored at a time.
BATCH, BATCH_POSTINGS = 128, 1_000_000
#: Query words that are broadcast at a time: about 40 MB.
QUERY_WORDS = 2_000_000
#: Scores are compared at six decimals, equal ones by id.
DECIMALS = 6

INDEX = T.StructType([
    T.StructField("docs", T.LongType()), T.StructField("words", T.LongType()),
    *(T.StructField(c, T.BinaryType()) for c in ("lengths", "terms", "starts", "members", "counts"))])


def _build(words: list[np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An inverted index in memory; returns the order of the documents and the arrays.

    Documents with the same commonest word become neighbours, so that blocks hold similar documents.
    """
    sizes = np.array([len(w) for w in words])
    flat, doc = np.concatenate(words), np.repeat(np.arange(len(words)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    new = np.concatenate([[True], (np.diff(flat) != 0) | (np.diff(doc) != 0)]) if len(flat) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    term, member = flat[at], doc[at]
    count = np.diff(np.append(at, len(flat)))
    terms, starts = np.unique(term, return_index=True)
    number = np.repeat(np.arange(len(terms)), np.diff(np.append(starts, len(term))))
    best = np.zeros(len(words), np.int64)
    np.maximum.at(best, member, count * len(terms) + number)
    rank = np.lexsort((sizes, best % max(len(terms), 1), best > 0))
    place = np.empty(len(words), np.int64)
    place[rank] = np.arange(len(words))
    member = place[member]
    again = np.argsort(number * len(words) + member)
    member, count = member[again], count[again]
    return rank, {"lengths": sizes[rank], "terms": terms, "starts": np.append(starts, len(term)).astype(np.int64),
                  "members": member.astype("<u2"), "counts": count.astype("<u4")}


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard of the documents (id, text): their ids and the arrays of the index."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), *INDEX.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[np.ndarray] = []
        kind = None

        def close() -> pa.RecordBatch:
            rank, arrays = _build(words)
            columns = [pa.array([[ids[i] for i in rank.tolist()]], pa.list_(kind)), pa.array([len(ids)], pa.int64()),
                       pa.array([int(arrays["lengths"].sum())], pa.int64())]
            columns += [pa.array([arrays[f.name].tobytes()], pa.binary()) for f in INDEX.fields[2:]]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, w in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist(), lower=True)):
                if ids and (len(ids) >= SHARD_DOCS or size + len(w) > SHARD_WORDS):
                    yield close()
                    ids, words, size = [], [], 0
                ids.append(key)
                words.append(w)
                size += len(w)
        if ids:
            yield close()

    return docs.mapInArrow(run, schema)


def _query_words(queries: DataFrame) -> DataFrame:
    """One row per query and distinct word: q, term, times."""
    bounded_batches(queries.sparkSession)
    schema = T.StructType([T.StructField("q", queries.schema["id"].dataType), T.StructField("term", T.LongType()),
                           T.StructField("times", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(w, return_counts=True) for w in word_hashes(batch.column(1).to_pylist(), lower=True)]
            row = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
            terms = np.concatenate([*(t for t, _ in found), np.zeros(0, np.uint64)]).view(np.int64)
            times = np.concatenate([*(n for _, n in found), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(terms), pa.array(times)], names=schema.names)

    return queries.mapInArrow(run, schema)


def _arrays(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    kinds = {"lengths": np.int64, "terms": np.uint64, "starts": np.int64, "members": "<u2", "counts": "<u4"}
    return {c: np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in kinds.items()}


def _document_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many documents each of a block's words occurs."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)
    schema = "term long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                a = _arrays(batch, i)
                _, here, there = np.intersect1d(wanted.value, a["terms"], True, True)
                total[here] += np.diff(a["starts"])[there]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted.value[some].view(np.int64)), pa.array(total[some])], names=["term", "docs"])

    rows = index.select("terms", "starts", "lengths", "members", "counts").mapInArrow(run, schema)
    got = rows.groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    counts = np.zeros(len(terms), np.int64)
    counts[np.searchsorted(terms, got["term"].to_numpy().view(np.uint64))] = got["docs"].to_numpy()
    wanted.unpersist()
    return counts


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the number of the range of each."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(which)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes), which


class _Shard:
    """The part of a shard's index that a query block can touch: postings of rare words, a matrix of common ones with block maxima."""

    def __init__(self, a: dict[str, np.ndarray], terms: np.ndarray, idf: np.ndarray, mean_length: float) -> None:
        _, known, here = np.intersect1d(terms, a["terms"], True, True)
        at, which = _ranges(a["starts"][:-1][here], a["starts"][1:][here])
        self.doc = a["members"][at].astype(np.int64)
        length = K1 * (1 - B + B * a["lengths"] / mean_length)
        tf = a["counts"][at].astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + length[self.doc]) * idf[known][which]
        self.docs = len(a["lengths"])
        sizes = np.bincount(which, minlength=len(known))
        self.starts = np.append(0, np.cumsum(sizes))
        self.local = np.full(len(terms), -1)
        self.local[known] = np.arange(len(known))
        common = np.argsort(-sizes, kind="stable")[:COMMON_WORDS]
        common = common[sizes[common] * COMMON_PART >= self.docs]
        self.column = np.full(len(known), -1)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((self.docs, len(common)))
        at, which = _ranges(self.starts[common], self.starts[common + 1])
        self.dense[self.doc[at], which] = self.impact[at]
        self.most = np.maximum.reduceat(self.dense, np.arange(0, self.docs, BLOCK_DOCS))

    def top(self, spans: np.ndarray, terms: np.ndarray, times: np.ndarray, least: np.ndarray, k: int,
            own: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a batch of queries, the documents that may be in the top k with a score of at least `least`: query, document, score.

        The pairs (query, document) of `own` are no result and do not raise the bound. Rare words are scored for every document; a
        document's common words are bounded by the maxima of its block, and only documents whose bound reaches the
        least score of any query of the batch are scored by them too.
        """
        n, t = len(spans) - 1, self.local[terms]
        query = np.repeat(np.arange(n), np.diff(spans))[t >= 0]
        times, t = times[t >= 0], t[t >= 0]
        column = self.column[t]
        common = column >= 0
        weights = np.zeros((n, self.dense.shape[1]))
        weights[query[common], column[common]] = times[common]
        score = np.zeros(n * self.docs)
        query, times, t = query[~common], times[~common], t[~common]
        first, sizes = self.starts[t], self.starts[t + 1] - self.starts[t]
        reached = np.cumsum(sizes)
        cuts = np.searchsorted(reached, np.arange(0, reached[-1] if len(t) else 0, BATCH_POSTINGS), side="right")
        for lo, hi in zip(cuts, np.append(cuts[1:], len(t))):
            at, _ = _ranges(first[lo:hi], first[lo:hi] + sizes[lo:hi])
            cell = np.repeat(query[lo:hi] * self.docs, sizes[lo:hi]) + self.doc[at]
            score += np.bincount(cell, self.impact[at] * np.repeat(times[lo:hi], sizes[lo:hi]), len(score))
        score = score.reshape(n, self.docs)
        score[own] = -np.inf
        least, new = least.copy(), np.isneginf(least)
        if new.any() and self.docs >= k:
            # Rare words alone give a k-th score that the whole one is not below.
            least[new] = np.round(np.partition(score[new], self.docs - k, axis=1)[:, self.docs - k], DECIMALS)
        bound = score + np.repeat(weights @ self.most.T, BLOCK_DOCS, axis=1)[:, :self.docs]
        reach = (bound > 0) & (bound * (1 + 1e-9) + 10.0 ** -DECIMALS >= least[:, None])
        some = reach.any(axis=0)
        exact = weights @ self.dense[some].T
        query, at = np.divmod(np.flatnonzero(reach), self.docs)
        exact = exact[query, np.cumsum(some)[at] - 1] + score[query, at]
        hit = (exact > 0) & (np.round(exact, DECIMALS) >= least[query])
        query, at, exact = query[hit], at[hit], np.round(exact[hit], DECIMALS)
        order = np.lexsort((-exact, query))
        last = np.searchsorted(query, np.arange(n)) + k - 1
        full = np.flatnonzero(last < np.searchsorted(query, np.arange(n), side="right"))
        least[full] = exact[order][last[full]]
        good = exact >= least[query]
        return query[good], at[good], exact[good]


def _alike(first: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of queries by their commonest word, so that neighbours need the same blocks; their spans there, and the order of their words."""
    ends = np.append(first[1:], len(place))
    most = np.repeat(np.maximum.reduceat(times, first), ends - first)
    order = np.argsort(np.maximum.reduceat(np.where(times == most, place, -1), first), kind="stable")
    at, _ = _ranges(first[order], ends[order])
    return order, np.append(0, np.cumsum((ends - first)[order])), at


def _score(index: DataFrame, ids: T.DataType, queries: list, spans: np.ndarray, terms: np.ndarray, place: np.ndarray, times: np.ndarray,
           idf: np.ndarray, mean_length: float, k: int) -> DataFrame:
    """Top documents of every task's shards for one block of queries: q, doc, score."""
    shared = index.sparkSession.sparkContext.broadcast((queries, spans, terms, place, times, idf))
    schema = T.StructType([T.StructField("q", ids), T.StructField("doc", ids), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, spans, terms, place, times, idf = shared.value
        best: list[list[tuple]] = [[] for _ in queries]
        asked, kind = {name: q for q, name in enumerate(queries)}, None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                shard, names = _Shard(_arrays(batch, i), terms, idf, mean_length), batch.column("ids")[i].values.to_pylist()
                # Rows of the query's own id, however many, do not count.
                own: list[tuple[int, int]] = sorted((asked[name], d) for d, name in enumerate(names) if name in asked)
                for lo in range(0, len(queries), BATCH):
                    hi = min(lo + BATCH, len(queries))
                    least = np.array([-mine[-1][0] if len(mine) == k else -np.inf for mine in best[lo:hi]])
                    mine = own[bisect_left(own, (lo, 0)):bisect_left(own, (hi, 0))]
                    span = slice(spans[lo], spans[hi])
                    found = shard.top(spans[lo:hi + 1] - spans[lo], place[span], times[span], least, k,
                                      ([q - lo for q, _ in mine], [d for _, d in mine]))
                    new: dict[int, list[tuple]] = {}
                    for q, d, s in zip(*(x.tolist() for x in found)):
                        new.setdefault(lo + q, []).append((-s, names[d]))
                    for q, rows in new.items():
                        best[q] = sorted(best[q] + rows)[:k]
        rows = [(name, doc, -s) for name, mine in zip(queries, best) for s, doc in mine]
        if rows:
            q, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, kind), pa.array(doc, kind), pa.array(score, pa.float64())], names=schema.names)

    # A task goes through several shards: the scores that it has found prune the next ones.
    tasks = index.sparkSession.sparkContext.defaultParallelism
    return index.coalesce(tasks).mapInArrow(run, schema)


def top_documents(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k: int = TOP) -> DataFrame:
    """Columns query_id, doc_id, score, rank: the k best documents for each query text, without the query's own id.

    Terms are words with A-Z lower-cased; a query counts each of its words as often as it has it. Documents
    that share no word with a query are no result, so an empty or null text finds and is found by nothing.
    Scores are compared at six decimals, equal ones by id. Rows without an id are neither
    queries nor results; rows of one id with different texts are results each, queries of one
    id are one query (the least text). Other columns are ignored.
    """
    rows = docs.where(docs[key].isNotNull()).select(docs[key].alias("id"), docs[text].alias("text"))
    asked = queries.where(queries[key].isNotNull()).groupBy(queries[key].alias("id")).agg(F.min(queries[text]).alias("text"))
    # A file per shard, so that tasks get as many shards each.
    index = stored(build_index(rows), "search-index", maxRecordsPerFile=1)
    words = stored(_query_words(asked), "search-queries")
    size = index.agg(F.sum("docs"), F.sum("words")).first()
    n, mean_length = size[0] or 0, (size[1] or 0) / max(size[0] or 0, 1)
    blocks = -(-words.count() // QUERY_WORDS)
    kind = docs.schema[key].dataType
    empty = T.StructType([T.StructField("q", kind), T.StructField("doc", kind), T.StructField("score", T.DoubleType())])
    found = docs.sparkSession.createDataFrame([], empty)
    for b in range(blocks):
        mine = words.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").toArrow()
        names, first = np.unique(mine["q"].to_numpy(zero_copy_only=False), return_index=True)
        terms, place = np.unique(mine["term"].to_numpy().view(np.uint64), return_inverse=True)
        df = _document_counts(index, terms)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        times = mine["times"].to_numpy().astype(np.float64)
        order, spans, at = _alike(first, place, times)
        found = found.union(_score(index, kind, names[order].tolist(), spans, terms, place[at], times[at], idf, mean_length, k))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), F.col("doc").alias("doc_id"), "score", "rank")
