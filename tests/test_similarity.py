"""Exact search and counts against all pairs in numpy."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talentmill.functions import vectors
from talentmill.functions.vectors import cosine, embedding_quality, hash_embed
from talentmill.operators import similarity
from talentmill.operators.similarity import best_hits, cosine_topk, count_hits, neighbour_counts

SCHEMA = "id long, embedding array<float>"


def table(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, m)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def similarities(a, b):
    def unit(m):
        m = np.asarray(m, dtype=np.float32).astype(float)
        return m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(unit(a) @ unit(b).T, 6)


def clustered(n_clusters=6, size=40, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, dim))
    m = np.concatenate([c + 0.15 * rng.normal(size=(size, dim)) for c in centres])
    m[50:110] = m[50]  # a pile of copies, a quarter of all rows
    return m


def brute_topk(q, c, k, own):
    s = similarities(q, c)
    out = set()
    for i in range(len(q)):
        order = sorted((j for j in range(len(c)) if not (own and i == j)), key=lambda j: (-s[i, j], j))
        out |= {(i, r + 1, j, s[i, j]) for r, j in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("k, pivots, block_rows", [(3, 8, 4096), (5, 4, 16), (1, 1, 7), (500, 5, 64)])
def test_topk_of_own_rows(spark, k, pivots, block_rows):
    m = clustered()
    got = cosine_topk(table(spark, m), k, pivots=pivots, block_rows=block_rows)
    assert {tuple(r) for r in got.collect()} == brute_topk(m, m, k, own=True)


@pytest.mark.parametrize("spread, chunk_bytes, entries", [(0.15, 2000, 1 << 20), (5.0, 600, 37), (5.0, 1 << 20, 50)])
def test_topk_moves_rows_to_their_nearest_cells_only(spark, monkeypatch, spread, chunk_bytes, entries):
    """Other cells come in chunks of bounded size: moving rows to every cell would grow with queries times cells."""
    met, meet = [], similarity._Cells.meet
    monkeypatch.setattr(similarity._Cells, "meet", lambda self, visits, *a: (met.append(visits.count()), meet(self, visits, *a))[1])
    monkeypatch.setattr(similarity, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(similarity, "ENTRIES", entries)
    monkeypatch.setattr(similarity, "HELD_ROWS", 30)
    rng = np.random.default_rng(11)
    m = np.concatenate([c + spread * rng.normal(size=(30, 12)) for c in rng.normal(size=(5, 12))])
    m[20:29] = np.round(m[20:29])
    m[40:50] = 2 * m[50:60]  # equal directions, so equal similarities
    got = cosine_topk(table(spark, m), 4, pivots=9, block_rows=16)
    assert {tuple(r) for r in got.collect()} == brute_topk(m, m, 4, own=True)
    assert len(met) == 1 and met[0] <= 3 * len(m)


def test_topk_of_other_queries_keeps_equal_ids(spark):
    m = clustered()
    q = m[[0, 60, 200]] + 0.01
    got = cosine_topk(table(spark, m), 4, queries=table(spark, q), pivots=6, block_rows=32)
    assert {tuple(r) for r in got.collect()} == brute_topk(q, m, 4, own=False)


@pytest.mark.parametrize("threshold, block_rows", [(0.9, 4096), (0.5, 16), (-1.0, 50)])
def test_counts(spark, threshold, block_rows):
    m = clustered()
    s = similarities(m, m)
    np.fill_diagonal(s, -np.inf)
    got = neighbour_counts(table(spark, m), threshold, pivots=7, block_rows=block_rows).collect()
    assert len(got) == len(m)
    for r in got:
        hits = s[r["id"]][s[r["id"]] >= threshold]
        assert r["similar"] == len(hits)
        assert r["highest"] == (hits.max() if len(hits) else None)


def test_cells_prune(spark):
    """With separate clusters, a query visits few cells."""
    from talentmill.operators.similarity import _Cells, _directed, _distinct
    from talentmill.session import materialise

    rows = materialise(_distinct(_directed(table(spark, clustered(size=40)))), "prune")
    cells = _Cells(rows, 12, 4096)
    reach = float(np.arccos(0.95))
    visits = cells.visits(rows, lambda low, _: low <= reach).count()
    assert visits < rows.count() * 12 / 2


def test_zero_vectors_take_no_part(spark):
    m = np.array([[1.0, 0], [0, 0], [1, 1], [0, 0]])
    got = {tuple(r)[:3] for r in cosine_topk(table(spark, m), 2).collect()}
    assert got == {(0, 1, 2), (2, 1, 0)}
    assert cosine_topk(table(spark, m[[1, 3]]), 2).count() == 0
    assert neighbour_counts(table(spark, m[[1, 3]]), 0.5).count() == 0


def test_hash_embedding(spark):
    texts = {1: "Python, AWS; python", 2: " \n", 3: None, 4: "python aws PYTHON", 5: "x" * 9000 + " tail"}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in hash_embed(rows).collect()}
    assert all(len(v) == 384 for v in got.values())
    assert not got[2].any() and not got[3].any()
    assert np.array_equal(got[1], got[4])
    for i in (1, 4, 5):
        assert np.linalg.norm(got[i]) == pytest.approx(1, abs=1e-6)
    assert int((got[5] != 0).sum()) == 2  # the tail of a long text counts


def test_cosine_of_zero_is_null(spark):
    row = spark.sql("select array(1F, 2F) a, array(0F, 0F) z, array(2F, 4F) b")
    got = row.select(cosine(F.col("a"), F.col("b")).alias("x"), cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert got["x"] == pytest.approx(1) and got["y"] is None


def test_quality(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0]), (5, None)], SCHEMA
    )
    assert embedding_quality(rows, 2).first().asDict() == {
        "vectors": 5, "missing": 1, "wrong_length": 1, "zero": 1, "not_unit": 1
    }


def test_memory_of_a_block_pair_is_bounded():
    """Two whole blocks meet in stretches: no matrix of all their pairs, and the same hits as from one."""
    rng = np.random.default_rng(1)
    q, c = (pd.DataFrame({"id": np.arange(4096) * 2 + i, "embedding": list(rng.normal(size=(4096, 16)).astype(np.float32)), "copies": 1})
            for i in (0, 1))
    whole = similarities(np.stack(q["embedding"]), np.stack(c["embedding"]))
    tracemalloc.start()
    best, counted = best_hits(q, c, 1), count_hits(q, c, 0.8, own=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < whole.nbytes
    assert best["neighbour"].tolist() == c["id"].to_numpy()[whole.argmax(axis=1)].tolist()
    hits = (whole >= 0.8).sum(axis=1)
    assert dict(zip(counted["id"], counted["hits"])) == {i: n for i, n in zip(q["id"], hits) if n}


def test_encoder_remembers_a_bounded_number_of_tokens(monkeypatch):
    texts = [" ".join(f"word{i * j % 97}" for j in range(60)) for i in range(40)] + [None, ""]
    want = vectors._encode(texts, 16)
    monkeypatch.setattr(vectors, "REMEMBERED", 5)
    vectors._slots.cache_clear()
    assert (vectors._encode(texts, 16) == want).all() and len(vectors._slots(16)) <= 5
