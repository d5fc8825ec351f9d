"""Files and logs on disk."""

from __future__ import annotations

import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentmill.operators import events
from talentmill.sources import files, logs


def test_resume_listing_and_decoding(spark, tmp_path):
    for name, body in {"b.pdf": b"two", "a.DOCX": b"one", "c.txt": b"no", "d.doc": b"\xff", "e.Pdf": b" ", "f.pdf": b""}.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.pdf").write_bytes(b"x")
    listed = [r["path"].rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()]
    assert listed == ["a.DOCX", "b.pdf", "d.doc", "e.Pdf"]
    assert files.load_files(spark, [str(tmp_path / "b.pdf")]).first()["content"] == b"two"
    decoders = {"pdf": lambda b: b.decode(), "docx": lambda b: b.decode("utf-8")}
    rows = files.decode_files(files.read_resume_files(spark, str(tmp_path)), decoders).collect()
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], (r["error"] or "").split(":")[0]) for r in rows}
    assert got == {
        "a.DOCX": ("one", ""), "b.pdf": ("two", ""), "d.doc": (None, "UnicodeDecodeError"), "e.Pdf": (" ", ""),
    }


def write_log(folder, name, lines):
    (folder / name).write_text("".join(line + "\n" for line in lines), encoding="utf-8")


def test_log_files(spark, tmp_path):
    good = json.dumps({"ts": "2024-01-01T00:00:00Z", "level": "INFO", "msg": "ok", "event": "db_query", "duration_ms": 5.5})
    write_log(tmp_path, "events.log", [good, "not json", good])
    write_log(tmp_path, "app.log", ["x" * 2047])
    write_log(tmp_path, "app.log.1", ["old"] * 50)
    stats = {r["log"]: (r["size_kb"], r["lines"]) for r in logs.log_file_stats(spark, str(tmp_path)).collect()}
    assert stats == {"events": (0.2, 3), "app": (2.0, 1)}
    rows = logs.read_events(spark, str(tmp_path / "events.log")).collect()
    assert sorted((r["level"], r["msg"], r["duration_ms"]) for r in rows if r["level"] != "UNKNOWN") == [("INFO", "ok", 5.5)] * 2
    assert [(r["msg"], r["event"]) for r in rows if r["level"] == "UNKNOWN"] == [("not json", None)]


def test_tail_drops_blanks_after_the_cut(spark):
    lines = [(i, '{"msg":"m%d","level":"INFO"}' % i if i % 3 else "  ") for i in range(10)]
    rows = spark.createDataFrame(lines, "n int, line string").repartition(4)
    got = events.tail(rows, ("n",), 4).orderBy("n").collect()
    assert [r["msg"] for r in got] == ["m7", "m8"]
    assert events.tail(rows.where("n > 99"), ("n",), 4).collect() == []


def test_event_records_round_and_flag(spark):
    rows = spark.createDataFrame(
        [("db_query", 500.0, 0.0), ("db_query", 500.004, 0.0), ("prediction_made", 12.345, 0.87654)],
        "event string, duration_ms double, score double",
    )
    for f in events.EVENT_SCHEMA.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    got = [(r["event"], r["level"], r["duration_ms"], r["slow"], r["score"]) for r in events.event_records(rows).collect()]
    assert got == [
        ("db_query", "DEBUG", 500.0, False, None), ("db_query", "WARNING", 500.0, True, None),
        ("prediction_made", "INFO", 12.35, None, 0.8765),
    ]


def test_slow_operations_need_level_and_word(spark):
    rows = spark.createDataFrame(
        [("WARNING", "x TOOK long"), ("INFO", "took"), ("ERROR", "db_query"), ("CRITICAL", "Timeout"), (None, "slow")],
        "level string, msg string",
    )
    assert [r["msg"] for r in events.slow_operations(rows).collect()] == ["x TOOK long", "Timeout"]


class Counting(io.BytesIO):
    taken = 0

    def read(self, size=-1):
        data = super().read(size)
        self.taken += len(data)
        return data


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé \t", max_size=9), max_size=30), st.booleans(), st.integers(1, 12), st.integers(1, 40))
def test_last_lines_of_any_file(lines, ended, n, block):
    data = "\n".join(lines).encode() + (b"\n" if ended and lines else b"")
    whole = data[:-1] if data.endswith(b"\n") else data
    starts = [0] + [i + 1 for i, b in enumerate(whole) if b == 10]
    want = list(zip(starts, whole.decode().split("\n")))[-n:] if data else []
    assert logs._last_lines(io.BytesIO(data), len(data), n, block) == want


def test_tail_reads_the_end_of_the_file_only():
    data = b"".join(b"line %d\n" % i for i in range(200_000))
    stream = Counting(data)
    assert [line for _, line in logs._last_lines(stream, len(data), 3, 64)] == [f"line {i}" for i in range(199_997, 200_000)]
    assert stream.taken <= 128


def test_tail_over_rotated_files(spark, tmp_path):
    lines = ['{"msg":"m%d","level":"INFO"}' % i for i in range(9)]
    (tmp_path / "a 1%.log").write_bytes("\r\n".join(lines[:4]).encode() + b"\r\n")
    (tmp_path / "a 2%.log").write_bytes(("\n".join(["", "cut {", *lines[4:], " "])).encode())
    (tmp_path / "b.txt").write_text("other\n")
    got = [(r["file"], r["line"]) for r in logs.last_lines(spark, str(tmp_path), 2).orderBy("file", "offset").collect()]
    assert got == [("a 1%.log", lines[2]), ("a 1%.log", lines[3]), ("a 2%.log", lines[8]), ("a 2%.log", " ")]
    assert sorted(r["msg"] for r in logs.tail_log(spark, str(tmp_path), 9).collect()) == ["cut {", *(f"m{i}" for i in range(3, 9))]
    assert logs.tail_log(spark, str(tmp_path), 1).collect() == []
    assert logs.tail_log(spark, str(tmp_path), 0).collect() == []


def test_saved_files_appear_whole_under_their_names(spark, tmp_path):
    rows = spark.createDataFrame(
        [("x/a b%20.pdf", bytearray(b"\xffone")), ("c.doc", bytearray(b"two")), ("null.pdf", None), ("x/empty.pdf", bytearray())], "path string, content binary")
    for _ in range(2):
        assert {tuple(r) for r in files.save_files(rows, f"file:{tmp_path}").collect()} == {("x/a b%20.pdf", 4), ("c.doc", 3), ("x/empty.pdf", 0)}
    assert (tmp_path / "x" / "a b%20.pdf").read_bytes() == b"\xffone"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")) == ["a b%20.pdf", "c.doc", "empty.pdf"]


def test_small_files_share_tasks(spark, tmp_path):
    """Loading takes a task per core for small files, not one per 32, and still gives every file."""
    for i in range(600):
        (tmp_path / f"{i}.pdf").write_bytes(b"%d" % i)
    loaded = files.load_files(spark, [str(tmp_path)])
    assert loaded.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
    assert sorted(int(r.content) for r in loaded.select("content").collect()) == list(range(600))
