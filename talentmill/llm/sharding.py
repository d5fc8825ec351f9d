"""Sharding by extendible hashing: only oversized buckets split on another bit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by which one round refines the directory: an aggregate of at most 2^16 cells per open bucket.
ROUND_BITS = 16
#: 48 bits of the key's hash, then 48 of the row's position for rows that share one key.
ROUNDS = 6
SHARD_BYTES = 64 << 20


def _bits(key: Column, position: Column, r: int) -> Column:
    """Bits 16r to 16r + 15 of a row's hash, as a string."""
    source, k = (key, r) if r < ROUNDS // 2 else (position, r - ROUNDS // 2)
    return F.lpad(F.conv(F.substring(F.md5(source), 4 * k + 1, 4), 16, 2), ROUND_BITS, "0")


def assign_shards(docs: DataFrame, key: str = "doc_id", size: Column | None = None,
                  limit: int = SHARD_BYTES) -> DataFrame:
    """Give every row its shard: columns `doc` (struct of the input row), `n_bytes`, `shard`
    (the hash prefix as a bit string), `depth`, `shard_bytes`, `shard_rows`.

    A directory indexed by hash-prefix bits starts as one bucket; a bucket over the limit splits
    on the next bit, all others stay. So a row's depth is the least number of bits at which
    its bucket fits. The buckets are found from sums per 16-bit cell, not from the rows: one
    aggregate, then more only for cells that are still too large. A bucket of one row cannot be
    split and counts as fitting, even over the limit. Rows that share a key split further by
    the hash of their position. Null keys hash as the empty string, null texts have size 0;
    an empty table gives an empty result.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) if size is None else size
    rows = docs.select(
        F.struct("*").alias("doc"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("n_bytes"))
    position = F.monotonically_increasing_id().cast("string")
    open_rows = rows.withColumn("_bits", _bits(F.col("_key"), position, 0))
    done, prefix = [], F.lit("")
    for r in range(ROUNDS):
        cells = open_rows.groupBy("_bits").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        lowest = ROUND_BITS * r + (r > 0)
        marks = cells.select("*", F.explode(F.sequence(F.lit(lowest), F.lit(ROUND_BITS * (r + 1)))).alias("depth")) \
            .withColumn("shard", F.substring(F.col("_bits"), F.lit(1), F.col("depth")))
        buckets = marks.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")) \
            .where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        directory = marks.join(buckets, "shard").groupBy("_bits").agg(
            F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("leaf"))
        # The first directory has at most 2^16 cells, a few MB: rows need not move.
        joined = open_rows.join(F.broadcast(directory) if r == 0 else directory, "_bits", "left")
        last = r == ROUNDS - 1
        done.append((joined if last else joined.where(F.col("leaf").isNotNull())).select(
            "doc", "n_bytes", "leaf.shard", "leaf.depth", "leaf.shard_bytes", "leaf.shard_rows"))
        if last or cells.join(directory, "_bits", "left_anti").isEmpty():
            break
        # monotonically_increasing_id needs the row order of the scan: it is taken before any join moves rows.
        prefix = F.concat(prefix, _bits(F.col("_key"), position, r))
        deeper = rows.select("*", prefix.alias("_cell"), F.concat(prefix, _bits(F.col("_key"), position, r + 1)).alias("_next"))
        too_large = cells.join(directory, "_bits", "left_anti").select(F.col("_bits").alias("_cell"))
        open_rows = deeper.join(too_large, "_cell", "left_semi").drop("_cell").withColumnRenamed("_next", "_bits")
    return reduce(DataFrame.unionByName, done)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", limit: int = SHARD_BYTES) -> DataFrame:
    """Write the rows as one Parquet file per shard folder; the input's columns stay as they are."""
    sharded = assign_shards(docs, key, limit=limit)
    sharded.select("doc.*", F.concat(F.lit("s"), "shard").alias("shard_id")).repartition("shard_id") \
        .write.partitionBy("shard_id").parquet(path)
    return sharded
