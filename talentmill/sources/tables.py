"""Domain tables on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from .buckets import Bucketed, exists


def bucketed(spark: SparkSession, root: str, name: str) -> Bucketed:
    return Bucketed(spark, f"{root.rstrip('/')}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A domain table with its fixed schema; no inference. A folder of plain Parquet files is read as it is."""
    table, place = TABLES[name], bucketed(spark, root, name)
    return place.read(table.schema) if place.exists else spark.read.schema(table.schema).parquet(place.folder)


def append_rows(df: DataFrame, root: str, name: str) -> None:
    """Add rows: to the partitions of a table that has some, else to its id buckets."""
    rows, keys = df.select(*TABLES[name].schema.names), TABLES[name].partition_by
    if keys:
        rows.write.mode("append").partitionBy(*keys).parquet(f"{root.rstrip('/')}/{name}")
    else:
        bucketed(df.sparkSession, root, name).append(rows)


EMBEDDINGS = "id long, embedding array<float>, run long"


def _embeddings_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/embeddings/entity={name}"


def _stored_embeddings(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = _embeddings_path(root, name)
    if exists(spark, path):
        return spark.read.schema(EMBEDDINGS).parquet(path)
    # The optimizer sees that this is empty, and drops a join with it.
    return spark.createDataFrame([], EMBEDDINGS).where(F.lit(False))


def read_embeddings(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Newest embedding per row of a table (id, embedding); empty if none is stored."""
    return _stored_embeddings(spark, root, name).groupBy("id").agg(F.max_by("embedding", "run").alias("embedding"))


def append_embeddings(vectors: DataFrame, root: str, name: str) -> None:
    """Append a run of embeddings (id, embedding) to those of a table; nothing stored is rewritten."""
    run = (_stored_embeddings(vectors.sparkSession, root, name).agg(F.max("run")).first()[0] or 0) + 1
    rows = vectors.select("id", "embedding", F.lit(run).cast("long").alias("run"))
    rows.write.mode("append").parquet(_embeddings_path(root, name))


def reset_tables(spark: SparkSession, root: str) -> None:
    """Empty all tables but users."""
    for name, table in TABLES.items():
        if name != "users":
            if table.partition_by:
                empty = spark.createDataFrame([], table.schema)
                empty.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")
            else:
                place = bucketed(spark, root, name)
                place.clear()
                place.expire()
            spark.createDataFrame([], EMBEDDINGS).write.mode("overwrite").parquet(_embeddings_path(root, name))
