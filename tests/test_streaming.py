"""Streams give what the batch operators give."""

from __future__ import annotations

import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from talentmill.functions.vectors import hash_embed
from talentmill.plans.queries import QUERIES
from talentmill.sources import files, logs, star_views
from talentmill.streaming import jobs


def event(i, **extra):
    ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    return {"ts": ts.isoformat() + "Z", "event": "db_query", "level": "WARNING", "msg": f"took {i}", "request_id": str(i),
            "duration_ms": float(i), **extra}


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(e) + "\n" for e in events))


def test_metrics_stream_equals_batch_on_closed_windows(spark, tmp_path):
    src = tmp_path / "in"
    for part in range(4):
        write(src, f"{part}.json", [event(i, error="x" if i % 7 == 0 else None) for i in range(part * 100, part * 100 + 100)])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.run_available(jobs.event_histogram(logs.stream_events(spark, str(src), 1)), out, check)
    batch = jobs.event_metrics(jobs.event_histogram(logs.read_events(spark, str(src))))
    closed = batch.where(F.col("window_end") <= F.lit("2024-01-01 06:29:00").cast("timestamp"))
    key = ["window_start", "window_end", "event", "calls", "errors", "avg_ms", "max_ms", "p95_ms"]
    got = sorted(map(tuple, jobs.event_metrics(spark.read.parquet(out)).select(key).collect()))
    assert got == sorted(map(tuple, closed.select(key).collect())) and len(got) == 6


def test_duplicates_across_files(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [event(i) for i in range(10)])
    write(src, "2.json", [event(i) for i in range(5, 15)])
    rows = jobs.without_duplicates(logs.stream_events(spark, str(src), 1), ["request_id"], "1 hour")
    jobs.run_available(rows, str(tmp_path / "out"), str(tmp_path / "check"))
    got = [int(r["request_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(15))
    batch = jobs.without_duplicates(logs.read_events(spark, str(src)), ["request_id"])
    assert batch.count() == 15


def test_alerts(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [event(i, level="INFO" if i % 2 else "ERROR") for i in range(10)])
    jobs.run_available(
        jobs.slow_operation_alerts(logs.stream_events(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "check")
    )
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_incremental_embedding_is_idempotent(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")

    def load(check):
        stream = spark.readStream.schema("id long, text string").parquet(src)
        jobs.incremental_load(stream, store, str(tmp_path / check), lambda b: hash_embed(b, dim=8))

    def stored():
        return sorted(r["id"] for r in spark.read.parquet(store).collect())

    first = spark.range(20).select("id", F.concat(F.lit("text "), "id").alias("text"))
    first.write.parquet(src)
    load("check")
    assert stored() == list(range(20))
    first.where("id > 14").unionByName(first.select((F.col("id") + 15).alias("id"), "text")).write.mode("append").parquet(src)
    load("check")
    assert stored() == list(range(35))
    load("check")
    load("fresh-check")  # a lost checkpoint replays every file
    assert stored() == list(range(35))
    assert jobs.read_store(spark, store).columns == ["id", "embedding"]


def test_p95_lies_within_its_stated_error(spark):
    values = [0.0, -1.0, 0.0004, 0.25, 0.255, 0.256, 1.0, 3.25, 17.0, 999.9, 65536.0, 1e9, None]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select(
        "x", jobs.duration_bin(F.col("x")).alias("bin"), jobs.upper_edge_ms(jobs.duration_bin(F.col("x"))).alias("edge"))
    got = {r.x: r for r in rows.collect()}
    assert got[None].bin is None and got[-1.0].bin == 0
    for x in values[2:-1]:
        us = int(x * 1000) / 1000
        assert us <= got[x].edge <= us * (1 + 1 / 128)
    known = sorted(x for x in values if x is not None)
    assert [got[x].bin for x in known] == sorted(got[x].bin for x in known)


def test_file_stream_resumes_and_keeps_failures_apart(spark, tmp_path):
    box = tmp_path / "box"
    (box / "old").mkdir(parents=True)
    (box / "a b.pdf").write_bytes(b"Jane Doe\njane@x.org\nPython")
    (box / "bad.doc").write_bytes(b"\xff")
    (box / "old" / "deep.pdf").write_bytes(b"Not here")

    def run():
        rows = files.stream_resume_files(spark, str(box), files_per_trigger=1)
        jobs.ingest_file_stream(rows, f"{tmp_path}/store", f"{tmp_path}/checkpoint", {"pdf": bytes.decode, "docx": bytes.decode}, 2026)
        return [
            sorted((r["path"].rsplit("/", 1)[1], r["status"]) for r in jobs.read_ingested(spark, f"{tmp_path}/store", q).collect())
            for q in (False, True)]

    assert run() == [[("a b.pdf", "parsed")], [("bad.doc", "failed")]]
    (box / "blank.PDF").write_bytes(b" ")
    (box / "new.docx").write_bytes(b"Omar Khan\nGo")
    stored = {p.name for p in (tmp_path / "store").rglob("part-*")}
    assert run() == [[("a b.pdf", "parsed"), ("new.docx", "parsed")], [("bad.doc", "failed"), ("blank.PDF", "rejected")]]
    assert stored < {p.name for p in (tmp_path / "store").rglob("part-*")}
    assert run() == [[("a b.pdf", "parsed"), ("new.docx", "parsed")], [("bad.doc", "failed"), ("blank.PDF", "rejected")]]


def test_file_stream_keeps_no_names_in_the_driver(spark, tmp_path, monkeypatch):
    """Offsets count chunks of a listing: a driver that holds a status of each file fails at some millions of them."""
    box = tmp_path / "box"
    box.mkdir()
    for i in range(25):
        (box / f"cv {i}.pdf").write_bytes(b"Jane Doe\nPython")
    for name in ("note.txt", "_hidden.pdf", ".hidden.pdf"):
        (box / name).write_bytes(b"no")
    (box / "empty.pdf").touch()
    monkeypatch.setattr(files, "CHUNK_FILES", 4)

    def run(check):
        rows = files.stream_resume_files(spark, str(box))
        jobs.ingest_file_stream(rows, f"{tmp_path}/store-{check}", f"{tmp_path}/{check}", {"pdf": bytes.decode}, 2026)
        return sorted(r["path"].rsplit("/", 1)[1] for r in jobs.read_ingested(spark, f"{tmp_path}/store-{check}").collect())

    want = sorted(f"cv {i}.pdf" for i in range(25))
    assert run("check") == want
    (box / "cv 3.pdf").write_bytes(b"Again\nGo")
    (box / "cv 25.pdf").write_bytes(b"Omar Khan\nGo")
    assert run("check") == sorted([*want, "cv 25.pdf"])
    (box / "cv 7.pdf").unlink()
    assert run("fresh") == sorted({*want, "cv 25.pdf"} - {"cv 7.pdf"})
    assert not any(b"cv " in p.read_bytes() for p in (tmp_path / "check").rglob("*") if p.is_file())


def test_files_per_trigger_and_a_lost_listing(tmp_path, monkeypatch):
    box = tmp_path / "box"
    box.mkdir()
    for i in range(5):
        (box / f"{i}.pdf").write_bytes(b"x")

    def reader():
        return files._Arrivals(f"file:{box}", f"{tmp_path}/listing", 2)

    monkeypatch.setattr(files, "COMPARED", 3)
    first, offsets = reader(), []
    offsets = [first.latestOffset(), first.latestOffset(), reader().latestOffset(), reader().latestOffset()]
    assert [(o["chunks"], o["more"]) for o in offsets] == [(1, True), (2, True), (3, False), (3, False)]
    parts = reader().partitions(first.initialOffset(), offsets[-1])
    read = [r["path"] for p in parts for batch in reader().read(p) for r in batch.to_pylist()]
    assert sorted(read) == [f"file:{box}/{i}.pdf" for i in range(5)]
    assert reader().partitions(offsets[1], offsets[2])[0].value == 2
    shutil.rmtree(tmp_path / "listing")
    with pytest.raises(ValueError, match="listing"):
        reader().partitions(offsets[0], reader().latestOffset())


@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_of_one_file_or_many_is_streamed_whole(spark, tmp_path, small_dir, parts):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    if parts:
        docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        shutil.copy(f"{small_dir}/documents.parquet", tmp_path)
    want = spark.read.parquet(f"{small_dir}/documents.parquet").count()
    rows = star_views.stream_table(spark, str(tmp_path), "documents").select("doc_id")
    jobs.run_available(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.schema("doc_id long").parquet(f"{tmp_path}/out")
    assert (got.count(), got.distinct().count()) == (want, want)
    embedded = QUERIES["stream_incremental_embed"](spark, str(tmp_path))
    assert embedded.select("doc_id").distinct().count() == QUERIES["stream_incremental_embed"](spark, small_dir).select("doc_id").distinct().count()
