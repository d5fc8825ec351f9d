"""JSON-lines event logs, batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import CORRUPT, EVENT_SCHEMA, LINE_SCHEMA, tail
from ..session import ship_package
from .files import file_system

#: Bytes of the first block that is read from a file's end.
TAIL_BLOCK = 1 << 16


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Typed events; broken lines keep their text in msg with level UNKNOWN."""
    return _repaired(spark.read.schema(LINE_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT).json(path))


def stream_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same rows as a stream over the files of a folder."""
    reader = spark.readStream.schema(LINE_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _repaired(reader.json(path))


def _repaired(rows: DataFrame) -> DataFrame:
    broken = F.col(CORRUPT).isNotNull()
    fixed = {
        "msg": F.when(broken, F.trim(CORRUPT)).otherwise(F.col("msg")),
        "level": F.when(broken, F.lit("UNKNOWN")).otherwise(F.col("level")),
    }
    return rows.withColumns(fixed).select(*EVENT_SCHEMA.names)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(log, line, size) of the current *.log files; rotated ones are not read."""
    return (
        spark.read.option("pathGlobFilter", "*.log").text(folder)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.log$", "").alias("log"),
            F.col("value").alias("line"),
            F.col("_metadata.file_size").alias("size"),
        )
    )


def log_file_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Line count and file size in KB (one decimal) per log file."""
    return read_lines(spark, folder).groupBy("log").agg(
        F.round(F.max("size").cast("decimal(20,0)") / 1024, 1).cast("double").alias("size_kb"),
        F.count("*").alias("lines"),
    )


def _last_lines(stream: BinaryIO, size: int, n: int, block: int) -> list[tuple[int, str]]:
    """(offset, line) of the last n lines; blocks from the end, each twice as long, until they hold them."""
    data, start = b"", size
    while start > 0 and data.count(b"\n", 0, max(len(data) - 1, 0)) < n:
        step = min(max(block, len(data)), start)
        start -= step
        stream.seek(start)
        data = stream.read(step) + data
    whole = data[:-1] if data.endswith(b"\n") else data
    out, at = [], start
    for line in whole.split(b"\n") if size else []:
        out.append((at, line))
        at += len(line) + 1
    # Where reading did not begin at the file's start, the first piece is cut; n whole lines follow it.
    return [(at, line.removesuffix(b"\r").decode("utf-8", "replace")) for at, line in out[max(len(out) - n, 0):]]


def last_lines(spark: SparkSession, folder: str, n: int, pattern: str = "*.log", block: int = TAIL_BLOCK) -> DataFrame:
    """(file, offset, line): the last n lines of every file that matches, at their byte offsets.

    Only the ends of the files are read, in the tasks; n and the lines' lengths bound the memory, not the files. Lines end with
    a line feed, a carriage return before it is dropped; the last one may lack both. An empty file has no line.
    """
    ship_package(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size in zip(batch["path"], batch["length"]):
                system, place = file_system(path)
                with system.open_input_file(place) as stream:
                    found = _last_lines(stream, int(size), n, block)
                yield pd.DataFrame({
                    "file": path.rsplit("/", 1)[1], "offset": [at for at, _ in found], "line": [line for _, line in found]})

    return listed.mapInPandas(read, "file string, offset long, line string")


def tail_log(spark: SparkSession, folder: str, n: int = 100, pattern: str = "*.log") -> DataFrame:
    """The last n physical lines of the files in name order, parsed; blank ones among them are dropped."""
    return tail(last_lines(spark, folder, n, pattern), ("file", "offset"), n)
