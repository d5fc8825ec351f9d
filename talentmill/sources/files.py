"""Resume files as a binary source, batch and streaming, with a pluggable decoder."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from hashlib import md5
from itertools import islice
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.vocab import RESUME_TYPES
from ..operators.parsing import route_files
from ..session import shared_root, ship_package

# Extensions in any case, one file name pattern.
_ANY_CASE = ",".join("".join(f"[{c}{c.upper()}]" for c in ext) for ext in RESUME_TYPES)
ACCEPTED = f"*.{{{_ANY_CASE}}}"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


#: Bytes that opening a file counts for. By Spark's 4 MB a task would get 32 small files, and millions of them a hundred thousand tasks.
OPEN_COST = 64 << 10
#: Tasks that list the files of a batch; by default there is one for each of up to 10,000 files.
LISTING_TASKS = 64


def many_small_files(spark: SparkSession) -> None:
    """Make ready to read many small files: the session counts them by about their bytes when it deals them to tasks."""
    spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST))
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there; names may hold blanks and percent signs."""
    found = re.fullmatch(r"(?s)([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)", uri)
    if not found or found[1].lower() == "file":
        return fs.LocalFileSystem(), found[3] if found else uri
    system, root = fs.FileSystem.from_uri(f"{found[1]}:{found[2] or '//'}/")
    return system, root.rstrip("/") + found[3]


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row's content to the file folder/path and give (path, length) of what was written; lazy, so read the result.

    Content is binary or text; null content writes no file. A file appears whole or not at all: it is written under a name of its own task
    attempt and renamed, so a repeated task leaves the same file. Of several rows of one path any may stay.
    """
    ship_package(files.sparkSession)
    rows = files.where(F.col("content").isNotNull()).select("path", F.col("content").cast("binary").alias("content"))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        system, root = file_system(folder)
        made, attempt = set(), TaskContext.get().taskAttemptId()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{root.rstrip('/')}/{path}"
                place, name = target.rsplit("/", 1)
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                hidden = f"{place}/_{attempt}_{name}"
                with system.open_output_stream(hidden) as out:
                    out.write(bytes(content))
                system.move(hidden, target)
            yield pd.DataFrame({"path": batch["path"], "length": [len(c) for c in batch["content"]]})

    return rows.mapInPandas(save, "path string, length long")


def read_resume_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime, content) of the accepted files directly in a folder.

    Spark plans no split for a file of zero bytes, so such a file gives no row.
    """
    many_small_files(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", ACCEPTED).load(folder)


#: Names in a chunk of a listing, which is a task; names that are compared with the known ones at a time; bytes of files in an Arrow batch.
CHUNK_FILES, COMPARED, BATCH_BYTES = 1024, 1 << 16, 16 << 20


def _names(system: fs.FileSystem, root: str) -> Iterator[str]:
    """Names of the accepted files directly in a folder, one at a time for a local one. Spark passes over the hidden ones, too."""
    accepted = re.compile(rf"(?si)(?![_.]).*\.({'|'.join(RESUME_TYPES)})")
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(root) as entries:
            yield from (e.name for e in entries if accepted.fullmatch(e.name) and e.is_file())
    else:
        files = system.get_file_info(fs.FileSelector(root))
        yield from (f.base_name for f in files if f.type == fs.FileType.File and accepted.fullmatch(f.base_name))


def _digests(names: list[str]) -> np.ndarray:
    """16 bytes for each name, as two numbers."""
    return np.frombuffer(b"".join(md5(os.fsencode(n), usedforsecurity=False).digest() for n in names), np.uint64).reshape(-1, 2)


class _Arrivals(DataSourceStreamReader):
    """The files of a folder in the order in which they were first listed.

    A listing is a folder of numbered chunks, files of names, each written whole and never changed; an offset is a number of chunks, with the
    listing's own name. So the driver holds 16 bytes a file, and plans a chunk by its number; names and bytes are read in the tasks.
    """

    def __init__(self, folder: str, listing: str, most: int) -> None:
        self.folder, self.listing, self.most = folder, listing, most
        self.chunks, self.seen = 0, np.zeros((0, 2), np.uint64)

    def initialOffset(self) -> dict:
        return {"chunks": 0}

    def latestOffset(self) -> dict:
        system, root = file_system(self.folder)
        name, known, left = self._catch_up(), self.seen, self.most or None
        names, held = _names(system, root), []
        while (left is None or left > 0) and (some := list(islice(names, COMPARED))):
            digests = _digests(some)
            new = np.ones(len(some), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known[:, 0], digests[:, 0]), len(known) - 1)
                new = (known[at] != digests).any(axis=1)
            fresh = np.flatnonzero(new)[:left].tolist()
            held += [some[i] for i in fresh]
            left = left and left - len(fresh)
            while len(held) >= CHUNK_FILES:
                self._add(held[:CHUNK_FILES])
                del held[:CHUNK_FILES]
        if held:
            self._add(held)
        # Whether there may be further files that are left to the next trigger.
        return {"listing": name, "chunks": self.chunks, "more": left == 0}

    def _catch_up(self) -> str:
        """Read the chunks that have been added meanwhile, by an earlier run or by another stream of the folder; the listing's own name."""
        system, root = file_system(self.listing)
        system.create_dir(root, recursive=True)
        if system.get_file_info(f"{root}/name").type != fs.FileType.File:
            self._write("name", uuid4().hex.encode())
        found = [self.seen]
        while system.get_file_info(f"{root}/{self.chunks:09d}").type == fs.FileType.File:
            found.append(_digests(self._chunk(self.chunks)))
            self.chunks += 1
        self.seen = np.concatenate(found)
        self.seen = self.seen[np.argsort(self.seen[:, 0])]
        with system.open_input_stream(f"{root}/name") as stream:
            return stream.read().decode()

    def _write(self, name: str, data: bytes) -> None:
        """Write a file of the listing whole. If another stream was first, the run fails and the next one goes on from there."""
        system, root = file_system(self.listing)
        hidden = f"{root}/_{uuid4().hex}"
        with system.open_output_stream(hidden) as out:
            out.write(data)
        if isinstance(system, fs.LocalFileSystem):
            os.link(hidden, f"{root}/{name}")
            os.unlink(hidden)
        else:
            system.move(hidden, f"{root}/{name}")

    def _chunk(self, number: int) -> list[str]:
        system, root = file_system(self.listing)
        with system.open_input_stream(f"{root}/{number:09d}") as stream:
            return os.fsdecode(stream.read()).split("\0")

    def _add(self, names: list[str]) -> None:
        self._write(f"{self.chunks:09d}", os.fsencode("\0".join(names)))
        self.chunks += 1
        self.seen = np.concatenate([self.seen, _digests(names)])

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start.get("listing", end["listing"]) != end["listing"]:
            raise ValueError(f"the listing that the checkpoint counts is no longer at {self.listing}")
        return [InputPartition(n) for n in range(start["chunks"], end["chunks"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, root = file_system(self.folder)
        kinds = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])
        rows: list[tuple] = []
        for name in self._chunk(partition.value):
            info = system.get_file_info(f"{root}/{name}")
            if info.type != fs.FileType.File or not info.size:
                continue
            with system.open_input_stream(info.path) as stream:
                content = stream.read()
            changed = datetime.fromtimestamp((info.mtime_ns or 0) // 10**6 / 1000, timezone.utc)
            rows.append((f"{self.folder}/{name}", changed, len(content), content))
            if sum(r[2] for r in rows) >= BATCH_BYTES or len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)


class ResumeFiles(DataSource):
    """The stream source `resume_files`: options path, listing and files_per_trigger."""

    @classmethod
    def name(cls) -> str:
        return "resume_files"

    def schema(self) -> str:
        return FILE_SCHEMA

    def streamReader(self, schema) -> _Arrivals:
        return _Arrivals(self.options["path"], self.options["listing"], int(self.options["files_per_trigger"]))


def stream_resume_files(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same rows as a stream: each file that arrives is read once, by path; the checkpoint remembers which.

    The names lie in the shared folder (spark.checkpoint.dir), the checkpoint counts them by chunks; keep both. Files come in the order of their
    listing, and a file that has gone before it is read gives no row. At most files_per_trigger files are newly listed at a trigger.
    """
    ship_package(spark)
    spark.dataSource.register(ResumeFiles)
    place = re.sub(r"^file:/+", "/", folder).rstrip("/")
    place = place if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", place) else f"file:{os.path.abspath(place)}"
    listing = f"{shared_root(spark)}/listed-{md5(place.encode()).hexdigest()}"
    reader = spark.readStream.format("resume_files").schema(FILE_SCHEMA).option("listing", listing)
    return only_in(reader.option("files_per_trigger", files_per_trigger or 0).load(place), folder)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted files in path order, without their bytes."""
    return read_resume_files(spark, folder).drop("content").orderBy("path")


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bytes of the given files; a missing one fails the read."""
    many_small_files(spark)
    return spark.read.format("binaryFile").load(paths)


def decode_files(files: DataFrame, decoders: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """(path, text, error) by the decoder of each file's type.

    Decoders are plain functions keyed 'pdf' and 'docx', run inside the tasks on Arrow
    batches. A failing or missing decoder gives an error row, never a failed job.
    """
    routed = route_files(files).select("path", "content", "decoder", "error")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for content, decoder, error in zip(batch["content"], batch["decoder"], batch["error"]):
                text = None
                if error is None:
                    try:
                        text = decoders[decoder](bytes(content))
                    except Exception as problem:  # noqa: BLE001 - any decoder failure is a row
                        error = f"{type(problem).__name__}: {problem}"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": batch["path"], "text": texts, "error": errors})

    return routed.mapInPandas(decode, "path string, text string, error string")


def only_in(files: DataFrame, folder: str) -> DataFrame:
    """Files directly in the folder, for listings that were read recursively."""
    place = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/")
    return files.where(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).endswith(place))
