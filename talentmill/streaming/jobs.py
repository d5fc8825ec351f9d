"""Event metrics, alerts, duplicate removal and incremental embedding as streams.

The transformations run unchanged on batch frames; that is how they are tested.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import is_slow_operation
from ..operators.parsing import parse_documents
from ..sources.files import decode_files


#: Durations are binned by their SIGNIFICANT leading bits: a bin's upper edge exceeds each of its values by less than 1 / 128.
SIGNIFICANT = 8


def duration_bin(duration_ms: Column) -> Column:
    """Number of a duration's bin, growing with the duration in whole microseconds; null for null, the first for less than 0."""
    us = F.greatest(F.floor(duration_ms * 1000), F.lit(0)).cast("long")
    shift = F.greatest(F.length(F.bin(us)) - SIGNIFICANT, F.lit(0))
    leading = F.floor(us / F.pow(F.lit(2.0), shift)).cast("long")
    return F.when(duration_ms.isNotNull(), shift * (1 << SIGNIFICANT) + leading)


def upper_edge_ms(number: Column) -> Column:
    """The greatest duration of a bin, in milliseconds."""
    size = F.pow(F.lit(2.0), F.floor(number / (1 << SIGNIFICANT)))
    return ((F.pmod(number, F.lit(1 << SIGNIFICANT)) + 1) * size - 1) / 1000


def event_histogram(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, errors, total and maximum duration per window, event kind and duration bin.

    The bins are the state of a stream, at most a few thousand per window and kind however many events it has, and they
    merge by adding; event_metrics reads all figures off them.
    """
    grouped = events.withWatermark("ts", late).groupBy(
        F.window("ts", size), "event", duration_bin(F.col("duration_ms")).alias("bin")
    ).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum(F.col("duration_ms").cast("decimal(18,6)")).alias("total"),
        F.max("duration_ms").alias("max_ms"),
    )
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "event", "bin", "calls", "errors", "total", "max_ms")


def event_metrics(histogram: DataFrame) -> DataFrame:
    """Count, errors, mean, maximum and p95 duration per window and event kind, from the rows of event_histogram.

    p95_ms is the upper edge of the bin that holds the value of rank ceil(0.95 n): at most 1 / 128 above that value.
    """
    group = ("window_start", "window_end", "event")
    whole = Window.partitionBy(*group)
    timed = F.when(F.col("bin").isNotNull(), F.col("calls")).otherwise(0)
    ranked = histogram.withColumns({
        "reached": F.sum(timed).over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
        "timed": F.sum(timed).over(whole),
    })
    holds = F.col("bin").isNotNull() & (F.col("reached") * 100 >= F.col("timed") * 95)
    return ranked.groupBy(*group).agg(
        F.sum("calls").alias("calls"),
        F.sum("errors").alias("errors"),
        (F.sum("total").cast("double") / F.sum("calls")).alias("avg_ms"),
        F.max("max_ms").alias("max_ms"),
        upper_edge_ms(F.min(F.when(holds, F.col("bin")))).alias("p95_ms"),
    )


def slow_operation_alerts(events: DataFrame) -> DataFrame:
    """Slow-operation rows as they arrive; no state."""
    return events.where(is_slow_operation(F.col("level"), F.col("msg")))


def without_duplicates(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First row per key; in a stream, state is kept only as long as the watermark needs."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there into Parquet files, then stop."""
    query = (
        df.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that is there in update mode: every batch writes the rows that it changed.

    A batch overwrites its own folder, so a replayed batch leaves the same files. Windows that
    are still open appear at once and are corrected by later batches.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        df.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def newest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row per key of what run_updates has written."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


#: Key buckets of a store: a batch looks only into the buckets that it touches.
STORE_BUCKETS = 64


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The rows that incremental_load has stored."""
    return spark.read.parquet(store).drop("batch", "bucket")


def incremental_load(
    rows: DataFrame,
    store: str,
    checkpoint: str,
    job: Callable[[DataFrame], DataFrame],
    key: str = "id",
) -> StreamingQuery:
    """Run job on the rows of a stream whose key is not stored yet, and store the result.

    Each batch overwrites a folder of its own number, so a replayed batch stores the same rows once. Keys
    of other batches are looked up in the buckets that the batch touches (at most STORE_BUCKETS).
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(STORE_BUCKETS))

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            before = spark.read.parquet(store).where(F.col("batch") != number)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]
            seen = before.where(F.col("bucket").isin(touched)).select(key)
            fresh = fresh.join(seen.join(fresh.select(key), key, "left_semi"), key, "left_anti")
        job(fresh).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")

    query = (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def ingest_file_stream(
    files: DataFrame, store: str, checkpoint: str, decoders: dict[str, Callable[[bytes], str]], as_of_year: int,
) -> StreamingQuery:
    """Decode and parse every file that has arrived in a stream of resume files, then stop.

    Each batch overwrites a folder of its own number, split by status, in one pass: 'parsed' and, as quarantine with the
    error, 'rejected' (no text) and 'failed' (no decoder could read it). The checkpoint resumes after the last whole batch, and
    a batch that is run again leaves the same rows.
    """
    def load(batch: DataFrame, number: int) -> None:
        parsed = parse_documents(decode_files(batch, decoders).withColumnRenamed("error", "_failure"), as_of_year)
        failed = F.col("_failure").isNotNull()
        rows = parsed.withColumns({
            "status": F.when(failed, F.lit("failed")).otherwise(F.col("status")), "error": F.coalesce("_failure", "error"),
        }).drop("_failure")
        rows.write.mode("overwrite").partitionBy("status").parquet(f"{store}/batch={number}")

    while True:
        query = (
            files.writeStream.foreachBatch(load)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        # A run takes one batch of a source in Python; the source says whether its limit has left files for another.
        last = query.lastProgress
        if not last or not any(re.search(r"(?i)\bmore\W+true\b", str(s["endOffset"])) for s in last["sources"]):
            return query


def read_ingested(spark: SparkSession, store: str, quarantined: bool = False) -> DataFrame:
    """The parsed files of ingest_file_stream, or those in quarantine."""
    parsed = F.col("status") == "parsed"
    return spark.read.parquet(store).drop("batch").where(~parsed if quarantined else parsed)
