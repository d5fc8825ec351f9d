"""Session set-up and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "talentmill",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC time.

    On a cluster leave master and shuffle_partitions unset: the first comes from
    spark-submit, the second from the cluster defaults, and adaptive execution
    merges small partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # No call-site capture per column: large plans build several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per Spark context.

    Workers unpickle functions by module name, so they must be able to import it wherever
    the job was started. Spark's own file server hands the archive out.
    """
    context = spark.sparkContext
    if not getattr(context, "_talentmill_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="talentmill-"), "talentmill.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        context._talentmill_shipped = True
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only a local session without the setting gets one: on a cluster a folder of this machine
    would be invisible to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "talentmill-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path in the cluster's shared folder, until drop_intermediates."""
    path = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _intermediates.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_intermediates: dict[str, list[str]] = {}


_once: dict[tuple[str, str], str] = {}


def stored_once(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that many jobs of this application read: written to the shared folder at first use.

    The key names all that the table depends on; its source must not change meanwhile.
    """
    place = (spark.sparkContext.applicationId, key)
    rows = build()
    if place not in _once:
        path = shared_dir(spark, "once")
        rows.write.parquet(path)
        _once[place] = path
    return spark.read.schema(rows.schema).parquet(_once[place])


def drop_intermediates(spark: SparkSession, once: bool = True) -> None:
    """Delete what this application has put into the shared folder; call it when results are read.

    With once=False the tables of stored_once stay, for further jobs.
    """
    app = spark.sparkContext.applicationId
    if once:
        for place in [p for p in _once if p[0] == app]:
            del _once[place]
    kept = {path for (owner, _), path in _once.items() if owner == app}
    for path in _intermediates.pop(app, []):
        if path not in kept:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if kept:
        _intermediates[app] = sorted(kept)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
