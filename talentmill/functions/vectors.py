"""Vector expressions and the hashing encoder."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EMBEDDING_DIM, VECTOR
from ..session import ship_package

TOKEN = re.compile(r"\w+")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is null or zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


#: Tokens whose buckets a task remembers.
REMEMBERED = 1 << 18


class _Slots(dict):
    """Hash bucket of every token, moved up by dim if its sign is negative."""

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        digest = md5(token.encode("utf-8"), usedforsecurity=False).hexdigest()
        self[token] = slot = int(digest[:8], 16) % self.dim + (int(digest[8], 16) % 2) * self.dim
        return slot


_slots = lru_cache(_Slots)


def _encode(texts: Sequence[str | None], dim: int) -> np.ndarray:
    """Unit vectors of signed token counts, one row per text: one count over (row, slot) for all."""
    tokens = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    slots = np.fromiter(map(_slots(dim).__getitem__, chain.from_iterable(tokens)), np.int64)
    rows = np.repeat(np.arange(len(tokens)), [len(row) for row in tokens])
    counts = np.bincount(rows * (2 * dim) + slots, minlength=len(tokens) * 2 * dim).reshape(-1, 2, dim)
    vectors = (counts[:, 0] - counts[:, 1]).astype(float)
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, length, out=vectors, where=length > 0).astype(np.float32)


#: Rows that are counted together.
ENCODE_ROWS = 512


def hash_embed(
    df: DataFrame, key: str = "id", text: str = "text", dim: int = EMBEDDING_DIM,
    max_chars: int | None = None,
) -> DataFrame:
    """(key, embedding): signed token counts in dim hash buckets, L2-normalised.

    Blank text gives the zero vector. Arrow batches stream through each task, so there
    is no shuffle: counting tokens per bucket with groupBy would move several times the
    vectors. Encoders with a length limit pass max_chars; the default reads whole texts.
    """
    body = F.col(text) if max_chars is None else F.substring(text, 1, max_chars)
    slim = df.select(F.col(key).alias("key"), body.alias("text"))
    ship_package(df.sparkSession)
    schema = T.StructType([slim.schema["key"], T.StructField("embedding", VECTOR)])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), ENCODE_ROWS):
                part = batch.iloc[lo:lo + ENCODE_ROWS]
                yield pd.DataFrame({"key": part["key"], "embedding": list(_encode(part["text"].tolist(), dim))})

    return slim.mapInPandas(encode, schema).withColumnRenamed("key", key)


def embedding_quality(embeddings: DataFrame, dim: int, vector: str = "embedding", tolerance: float = 0.01) -> DataFrame:
    """How many vectors are missing, zero, of wrong length or not of unit norm."""
    v = F.col(vector)
    rows = embeddings.select(F.size(v).alias("len"), norm(v).alias("norm"), v.isNull().alias("missing"))
    return rows.agg(
        F.count("*").alias("vectors"),
        F.count_if(F.col("missing")).alias("missing"),
        F.count_if(~F.col("missing") & (F.col("len") != dim)).alias("wrong_length"),
        F.count_if(F.col("norm") == 0).alias("zero"),
        F.count_if((F.col("norm") != 0) & (F.abs(F.col("norm") - 1) > tolerance)).alias("not_unit"),
    )
