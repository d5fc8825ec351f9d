"""What write jobs took and did, as rows beside the tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import exists

SCHEMA = "operation string, elapsed_ms double, n_rows long, n_failed long, finished_at timestamp"


def _path(root: str) -> str:
    return f"{root.rstrip('/')}/job_timings"


def record(spark: SparkSession, root: str, operation: str, seconds: float, counts: Mapping[str, int]) -> None:
    """Append one row for a job that has run; counts are what an Observation saw (rows, failed)."""
    row = spark.createDataFrame(
        [(operation, seconds * 1000, counts.get("rows", 0), counts.get("failed", 0))], "operation string, elapsed_ms double, n_rows long, n_failed long")
    row.withColumn("finished_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(_path(root))


def read(spark: SparkSession, root: str) -> DataFrame:
    """All recorded jobs; none if no job has run."""
    return spark.read.schema(SCHEMA).parquet(_path(root)) if exists(spark, _path(root)) else spark.createDataFrame([], SCHEMA)
