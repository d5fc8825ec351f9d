"""Operator queries against their SQL counterparts, and the two without one against the tokenizer itself."""

from __future__ import annotations

import hashlib
import os
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, differences  # noqa: E402

from talentmill.llm.oracles import ORACLES, sharding_sql  # noqa: E402
from talentmill.llm.queries import QUERIES  # noqa: E402
from talentmill.llm.sharding import assign_shards  # noqa: E402


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.fixture(scope="module")
def tokens(spark, small_dir):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    return {r.doc_id: coder.encode(r.text or "", add_special_tokens=False).ids for r in rows}


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small_dir, con, name):
    assert differences(QUERIES[name](spark, small_dir), con, ORACLES[name]) == []


@pytest.mark.parametrize("limit", [256 << 10, 32 << 10, 4 << 10])
def test_shards_that_split_equal_sql(spark, small_dir, con, limit):
    """The query's own limit holds all of the small tables; these split them over several levels."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = assign_shards(docs, limit=limit).select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
    assert differences(rows, con, sharding_sql(limit)) == []
    assert rows.agg(F.max("depth")).first()[0] >= {256 << 10: 1, 32 << 10: 4, 4 << 10: 6}[limit]


def test_there_is_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_round_trip_equals_the_tokenizer(spark, small_dir, tokens):
    rows = QUERIES["op3_bpe_round_trip"](spark, small_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(tokens[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(packed(tokens[r.doc_id])).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_packing_places_every_id_once(spark, small_dir, tokens):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in QUERIES["op6_differencing_windows"](spark, small_dir).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(pieces) == set(tokens)
    for doc, cut in pieces.items():
        ids, at = [*tokens[doc], 1], 0
        for start, length, crc, total in sorted(cut):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(packed(ids[start:start + length])))
            at += length
        assert at == len(ids)
    filled = sum(n for placed in sequences.values() for _, n in placed)
    assert filled / (2048 * len(sequences)) > 0.97


def test_spans_are_counted_by_their_kind(spark, tmp_path):
    """Whatever the number and place of a text's spans: an email alone is no ip, and the second email is one more."""
    card = "4111111111111111"
    texts = [None, "a@b.c", "a@b.c d@e.f", "x 1.2.3.4", f"{card} a@b.c {card}", "+1 555 123 4567 1.2.3.4 a@b.c a@b.d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone"))
           for r in QUERIES["op2_pii_boosted_candidates"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (1, 0, 0, 0), 2: (2, 0, 0, 0), 3: (0, 1, 0, 0), 4: (1, 0, 2, 0), 5: (2, 1, 0, 1)}
