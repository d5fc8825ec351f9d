"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .chat import rotate_perspectives
from .common import read
from .divergence import source_divergence
from .langid import identify_language
from .lines import dedup_lines
from .minhash import near_duplicates
from .packing import pack
from .pii import KINDS, find_pii, span_list
from .quality import quality_rules
from .search import top_documents
from .sharding import assign_shards
from .spelling import spelling_variants
from .substrings import drop_repeated_windows

VOCABULARY = "byte_bpe_50k.json"


def op1_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)

    def count(k: int) -> Column:
        # A second argument of the lambda, defaulted or not, would be taken for the item's index.
        return F.size(F.filter("spans", lambda s: s.base & (s.kind == k))).cast("long")

    counts = (count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS))
    return found.select("doc.doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), decoded=True)
    return tokens.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_signature_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc.doc_id", "n_shingles", "component_id", "kept")


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return assign_shards(docs, size=F.col("size")).select(
        F.col("doc.doc_id").alias("doc_id"), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def op6_differencing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed_rules"))


def op9_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return top_documents(docs, docs.where("doc_id % 50 = 0"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(read(spark, sf_dir, "conversations"))


def op11_cube_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op12_partenum_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def op13_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deletion_line_dedup": op1_deletion_line_dedup,
    "op2_pii_boosted_candidates": op2_pii_boosted_candidates,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_signature_near_duplicates": op4_signature_near_duplicates,
    "op5_extendible_shards": op5_extendible_shards,
    "op6_differencing_windows": op6_differencing_windows,
    "op7_fm_index_substrings": op7_fm_index_substrings,
    "op8_quality_rules": op8_quality_rules,
    "op9_block_max_search": op9_block_max_search,
    "op10_perspective_rotation": op10_perspective_rotation,
    "op11_cube_source_divergence": op11_cube_source_divergence,
    "op12_partenum_spelling_variants": op12_partenum_spelling_variants,
    "op13_rank_order_language": op13_rank_order_language,
}
