"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package

#: Words are runs of anything but these six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Lets Spark delete the shuffle files of a write as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str, **options: int | str) -> DataFrame:
    """Write a table to the shared folder, with options of the writer, and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 16) -> None:
    """Make ready for a Python stage: workers get the package, Arrow batches a bound in rows and bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def where_last(df: DataFrame, condition: Column | str) -> DataFrame:
    """Filter on derived columns without the optimizer writing their whole derivation into the filter.

    A filter is not pushed through a projection with a row number, so long chains of derived
    columns are evaluated once per row and planned in linear time.
    """
    condition = F.expr(condition) if isinstance(condition, str) else condition
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.where(condition & (F.col("_row") >= 0)).drop("_row")


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.array_remove(parts, "")


def running(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Fold of all items before each one, for an array of longs, in O(n * sqrt(n)) with no shuffle.

    A fold that appends to an array copies it at every step. Folding within blocks of
    sqrt(n) items keeps that copy small; a block starts from the fold of what precedes it.
    """
    n, empty = F.size(values), F.array().cast("array<bigint>")
    block = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))

    def within(b: Column) -> Column:
        before = F.aggregate(F.slice(values, F.lit(1), b * block), start, lambda s, x: op(s, x))
        return F.aggregate(
            F.slice(values, b * block + 1, block), F.struct(before.alias("s"), empty.alias("out")),
            lambda acc, x: F.struct(op(acc.s, x).alias("s"), F.array_append(acc.out, acc.s).alias("out")),
            lambda acc: acc.out,
        )

    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(n / block).cast("int") - 1, F.lit(0)))
    return F.when(n > 0, F.flatten(F.transform(blocks, within))).otherwise(empty)
