"""From raw documents to packed training sequences.

Five stages, each written as Parquet and read again before the next: quality rules, line
dedup, near-duplicate removal, redaction of personal data, packing. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmill.llm.common import read, stored, where_last
from talentmill.llm.lines import dedup_lines
from talentmill.llm.minhash import drop_near_duplicates
from talentmill.llm.packing import pack
from talentmill.llm.pii import redact
from talentmill.llm.quality import keep_good

VOCABULARY = "byte_bpe_50k.json"


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of a line go; a document of which no line stays goes with them."""
    cleaned = where_last(dedup_lines(docs), "n_lines = 0 or n_removed < n_lines")
    return _counted(cleaned.select(*(
        F.col("kept_text").alias(c) if c == "text" else F.col(f"doc.{c}").alias(c) for c in docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a mark of its kind."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences of 2048."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: Token ids cannot be stated in SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
