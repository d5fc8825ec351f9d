"""Tables laid out by id bucket, whose newest version is published in one step.

A table's folder holds bucket=<b>/version=<v> folders of Parquet files and, in `_published`, one small
numbered table per published state that lists the live (bucket, version) pairs. A write adds version folders first and
publishes a new list last, so readers see the old state or the new one, and a job that fails leaves the old
one. Folders of untouched buckets stay in the next list as they are: their files are neither read nor written.
Two writers that start from one state publish under the same number, and the second one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "bucket int, version string, of int"
#: Buckets of a new table; a large one gets so many that a bucket is a few hundred MB.
BUCKETS = 64


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _path(spark, path)
    return fs.exists(place)


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, place = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _states(spark: SparkSession, folder: str) -> list[str]:
    """Published states, oldest first; one whose write did not end does not count."""
    published = f"{folder}/_published"
    return [f"{published}/{n}" for n in _children(spark, published) if "_SUCCESS" in _children(spark, f"{published}/{n}")]


class Bucketed:
    """A table folder; only names of folders, at most buckets times versions, pass through the driver."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.states = _states(spark, self.folder)
        rows = spark.read.schema(LISTED).parquet(self.states[-1]).collect() if self.states else []
        self.live = sorted((r["bucket"], r["version"]) for r in rows if r["bucket"] >= 0)
        self.of = rows[0]["of"] if rows else BUCKETS

    @property
    def exists(self) -> bool:
        return bool(self.states)

    def bucket(self, key: str = "id") -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.of)).cast("int")

    def read(self, schema, buckets: Collection[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; other buckets' files are not opened."""
        paths = [f"{self.folder}/bucket={b}/version={v}" for b, v in self.live if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> list[tuple[int, str]]:
        """New version folders for the buckets of the rows; not visible before they are published."""
        version = uuid.uuid4().hex
        dealt = rows.withColumns({"bucket": self.bucket(), "version": F.lit(version)}).repartition("bucket")
        dealt.write.mode("append").partitionBy("bucket", "version").parquet(self.folder)
        fs, place = _path(self.spark, f"{self.folder}/bucket=*/version={version}")
        return [(int(f.getPath().getParent().getName().partition("=")[2]), version) for f in fs.globStatus(place)]

    def _publish(self, live: Collection[tuple[int, str]]) -> None:
        number = int(self.states[-1].rpartition("=")[2]) + 1 if self.states else 0
        state = f"{self.folder}/_published/state={number:012d}"
        rows = [(b, v, self.of) for b, v in sorted(live)] + [(-1, "", self.of)]
        self.spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("errorifexists").parquet(state)
        self.states.append(state)
        self.live = sorted(live)

    def append(self, rows: DataFrame) -> None:
        self._publish({*self.live, *self._write(rows)})

    def clear(self, buckets: int | None = None) -> None:
        """Publish the empty table, with a new number of buckets if given."""
        self.of = buckets or self.of
        self._publish([])

    def update(self, changed: DataFrame, schema, change: Callable[[DataFrame], DataFrame], key: str = "id") -> None:
        """Put `change(rows)` in place of the rows of all buckets that the keys of `changed` fall into."""
        touched = {r[0] for r in changed.where(F.col(key).isNotNull()).select(self.bucket(key).alias("b")).distinct().collect()}
        touched &= {b for b, _ in self.live}
        if touched:
            new = self._write(change(self.read(schema, touched)).select(*schema.names))
            self._publish({*(x for x in self.live if x[0] not in touched), *new})

    def expire(self, keep: int = 1) -> None:
        """Delete the folders that only states before the last `keep` list, and those states."""
        old = self.states[:-keep] if keep else []
        if old:
            kept = {(r["bucket"], r["version"]) for r in self.spark.read.schema(LISTED).parquet(*self.states[-keep:]).collect()}
            gone = {(r["bucket"], r["version"]) for r in self.spark.read.schema(LISTED).parquet(*old).collect()} - kept
            for path in [*old, *(f"{self.folder}/bucket={b}/version={v}" for b, v in gone if b >= 0)]:
                fs, place = _path(self.spark, path)
                fs.delete(place, True)
            self.states = self.states[-keep:]
