"""Batch inserts, keyed updates and the table facade."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentmill.operators import parsing, seed, writes
from talentmill.operators.quality import contract_violations, split_valid
from talentmill.plans.warehouse import Warehouse
from talentmill.schemas import TABLES
from talentmill.sources import tables


@pytest.fixture
def house(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.reset()
    spark.createDataFrame([], TABLES["users"].schema).write.parquet(f"{tmp_path}/users")
    return w


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_ids_are_dense_and_do_not_depend_on_partitions(spark, partitions):
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    got = {r["key"]: r["id"] for r in writes.assign_ids(rows.repartition(partitions), "key", 100).collect()}
    assert sorted(got.values()) == list(range(101, 601))
    again = {r["key"]: r["id"] for r in writes.assign_ids(rows.coalesce(1), "key", 100).collect()}
    assert got == again


def test_insert_then_read(spark, house):
    lost = house.create_clients(spark.sql("select 'Acme' name union all select cast(null as string)"))
    assert [r["broken_rules"] for r in lost.collect()] == [["name not null"]]
    house.create_jobs(spark.sql("select 'Data Engineer' title, 1L client_id, array('Python') required_skills"))
    house.create_candidates(spark.sql(
        "select 'Jane' name, 'jane@x.com' email, array('Python') skills, 'citizen' visa_status, 5D yoe, 90D rate"
    ))
    house.create_candidates(spark.sql("select 'Omar' name, 'bad' visa_status union all select 'Ann', null"))
    assert [tuple(r) for r in house.get_candidates().select("id", "name", "visa_status", "yoe").orderBy("id").collect()] == [
        (1, "Jane", "citizen", 5.0), (2, "Ann", "unknown", 0.0),
    ]
    assert [tuple(r) for r in house.get_open_jobs().select("id", "title", "status", "remote_ok").collect()] == [
        (1, "Data Engineer", "open", False)
    ]
    client = house.get_client_by_id(1).first()
    assert (client["status"], client["req_volume"], client["margin_pct"]) == ("active", 0, 0.0)
    assert client["created_at"] is not None
    assert house.get_candidate_by_id(99).count() == 0
    assert house.get_candidates(active_only=True).count() == 0


def test_invalid_filter_values_raise(house):
    with pytest.raises(ValueError, match="job status"):
        house.get_jobs("opened")
    with pytest.raises(ValueError, match="placement stage"):
        house.get_placements(stage="lost")


def test_empty_results_keep_their_schema(house):
    assert house.get_placements(stage="hire").columns[:3] == ["id", "candidate_id", "job_id"]
    assert house.get_placement_funnel_counts().columns == ["stage", "count"]
    assert house.get_monthly_revenue().collect() == []


def test_predictions_round_trip(spark, house):
    scored = spark.sql("select 'candidate' entity_type, 1L entity_id, 0.87D score, 0.9D match_score, 0.8D skill_overlap")
    house.save_predictions(scored, "submission_success", ["match_score", "skill_overlap"])
    got = house.get_latest_predictions("submission_success", "candidate").first()
    assert (got["score"], got["features"]) == (0.87, '{"match_score":0.9,"skill_overlap":0.8}')
    assert house.get_latest_predictions("submission_success", "client").count() == 0


def test_predictions_newest_first_with_undated_in_front(spark, house):
    rows = spark.sql(
        "select * from values (1L, timestamp'2024-01-01'), (2L, null), (3L, timestamp'2024-02-01') t(id, created_at)"
    ).withColumns({"entity_type": F.lit("client"), "entity_id": F.lit(5), "model_name": F.lit("m"), "score": F.lit(1.0)})
    from talentmill.operators.scans import get_latest_predictions
    assert [r["id"] for r in get_latest_predictions(rows, "m").collect()] == [2, 3, 1]


def test_updates(spark, house):
    house.create_candidates(spark.sql("select 'A' name, 10D rate, 'x' location union all select 'B', 20D, 'y'"))
    ids = {r["name"]: r["id"] for r in house.get_candidates().collect()}
    t = dt.datetime(2030, 1, 1)
    changes = spark.createDataFrame(
        [
            (ids["A"], t, 1, ["rate"], 11.0, None), (ids["A"], t, 2, ["rate"], None, None),
            (ids["A"], t, 0, ["location"], None, "z"), (77, t, 3, ["rate"], 1.0, None),
        ],
        "id long, changed_at timestamp, seq int, set_fields array<string>, rate double, location string",
    )
    lost = house.update_candidates(changes, ["rate", "location"])
    assert [r["id"] for r in lost.collect()] == [77]
    got = {r["name"]: (r["rate"], r["location"], r["updated_at"] == t) for r in house.table("candidates").collect()}
    assert got == {"A": (None, "z", True), "B": (20.0, "y", False)}


def parents(spark, house):
    """Rows that links may name: one client, two candidates, one job."""
    house.create_clients(spark.sql("select 'K' name"))
    house.create_candidates(spark.sql("select 'A' name union all select 'B'"))
    house.create_jobs(spark.sql("select 'driver' title, 1L client_id"))


def test_stages_and_flags(spark, house):
    parents(spark, house)
    house.create_placements(spark.sql(
        "select 1L candidate_id, 1L job_id, 1L client_id union all select 2L, 1L, 1L"
    ))
    assert {r["stage"] for r in house.get_placements().collect()} == {"submitted"}
    now = dt.datetime(2030, 1, 1)
    changes = spark.createDataFrame(
        [(1, "hire", now, 1), (2, "gone", now, 2), (9, "offer", now, 3)],
        "id long, stage string, changed_at timestamp, seq int",
    )
    lost = house.update_placement_stages(changes)
    assert {(r["id"], r["reason"]) for r in lost.collect()} == {(2, "invalid stage"), (9, "unknown id")}
    assert {(r["stage"], r["count"]) for r in house.get_placement_funnel_counts().collect()} == {("hire", 1), ("submitted", 1)}
    house.create_timesheets(spark.sql(
        "select 1L contractor_id, date'2024-01-01' week_start, 70D hours union all select 2L, date'2024-01-01', 40D"
    ))
    sheets = {r["contractor_id"]: r["id"] for r in house.get_timesheets().collect()}
    house.flag_timesheet_anomalies(spark.createDataFrame([(sheets[1], 0.9, "long week")], "id long, score double, reason string"))
    got = house.get_timesheets(flagged_only=True).collect()
    assert [(r["id"], r["status"], r["anomaly_score"], r["anomaly_reason"]) for r in got] == [
        (sheets[1], "flagged", 0.9, "long week")
    ]


def test_ingest_and_embed(spark, house):
    files = spark.createDataFrame(
        [("r/a.pdf", "Jane Doe\nPython, AWS"), ("r/b.txt", "x"), ("r/c.docx", "  "), ("r/d.DOC", "Omar Khan\nGo")],
        "path string, text string",
    )
    outcome = {r["path"]: r["status"] for r in house.ingest_resumes(files, 2026).collect()}
    assert outcome == {"r/a.pdf": "parsed", "r/b.txt": "unsupported", "r/c.docx": "rejected", "r/d.DOC": "parsed"}
    assert house.embed_candidates() == 2
    assert house.embed_candidates() == 0
    assert {(r["operation"], r["n_rows"], r["n_failed"]) for r in house.job_timings().collect()} == {
        ("ingest_resumes", 4, 2), ("embed_candidates", 2, 0), ("embed_candidates", 0, 0)}
    assert {(r["operation"], r["calls"]) for r in house.get_job_latencies().collect()} == {("ingest_resumes", 1), ("embed_candidates", 2)}
    assert house.ingest_resumes(files.where("path = 'none'"), 2026).count() == 0
    assert house.embed_candidates(force=True) == 2
    assert [len(r["embedding"]) for r in house.embeddings("candidates").collect()] == [384, 384]
    house.reset()
    assert house.get_candidates().count() == 0 and house.embeddings("candidates").count() == 0


def test_inserts_keep_keys_and_links(spark, house):
    batch = spark.createDataFrame([("Ann", "a@x.de"), ("Ben", "b@x.de"), ("Bob", "b@x.de"), ("Cy", None)], "name string, email string")
    lost = house.create_recruiters(batch.coalesce(1))
    assert {(r["name"], *r["broken_rules"]) for r in lost.collect()} == {("Bob", "email unique"), ("Cy", "email not null")}
    again = house.create_recruiters(batch.where("name = 'Ann'"))
    assert [r["broken_rules"] for r in again.collect()] == [["email unique"]]
    assert sorted(r["name"] for r in house.get_recruiters().collect()) == ["Ann", "Ben"]
    jobs = house.create_jobs(spark.createDataFrame([("driver", 99), ("cook", None)], "title string, client_id long"))
    assert {tuple(r["broken_rules"]) for r in jobs.collect()} == {("client_id in clients",), ("client_id not null",)}
    bad = spark.sql("select 1L id, timestamp'2030-01-01' changed_at, 1 seq, array('email') set_fields, cast(null as string) email")
    assert [r["broken_rules"] for r in house.update(bad, "recruiters", ["email"]).collect()] == [["email not null"]]


def test_seeded_tables_meet_the_contracts(spark):
    tables = {
        "clients": seed.seed_clients(spark.range(10)),
        "recruiters": seed.seed_recruiters(spark.range(5)),
        "candidates": seed.seed_candidates(spark.range(400)),
        "jobs": seed.seed_jobs(spark.range(20), 10),
    }
    tables["placements"] = seed.seed_placements(spark.range(300), 400, 20, 5, tables["jobs"], "2026-06-01")
    contractors = tables["candidates"].where("is_active_contractor")
    tables["timesheets"] = seed.seed_timesheets(contractors, "2026-06-01")
    tables["payroll"] = seed.seed_payroll(contractors, "2026-06-01")
    assert contract_violations(tables).where("violations > 0").collect() == []
    share = contractors.count() / 400
    assert 0.3 < share < 0.5
    assert tables["timesheets"].count() == 12 * contractors.count()
    periods = {str(r["period"]) for r in tables["payroll"].select("period").distinct().collect()}
    assert periods == {"2026-04-01", "2026-05-01", "2026-06-01"}


def test_payroll_seed_does_not_skip_february(spark):
    rows = seed.seed_payroll(spark.sql("select 1L id, 100D rate"), "2026-03-31")
    assert sorted(str(r["period"]) for r in rows.collect()) == ["2026-01-01", "2026-02-01", "2026-03-01"]


def test_split_names_the_broken_rules(spark):
    rows = spark.sql("select 1L id, cast(null as string) name, repeat('x', 40) phone, 'nope' visa_status")
    good, bad = split_valid(rows, "candidates")
    assert good.count() == 0
    assert bad.first()["broken_rules"] == ["name not null", "visa_status in domain", "phone length <= 32"]


def _scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_contracts_read_every_table_once(spark, tmp_path):
    """Nulls break neither unique nor link rules; a parent that fills the child table costs no more; links to absent tables are no rule."""
    rows = {
        "clients": spark.sql("select * from values (1L, 'a'), (1L, 'b'), (null, 'c'), (2L, null) t(id, name)"),
        "recruiters": spark.sql("select * from values (1L, 'n', 'x@y.z'), (2L, 'n', 'x@y.z'), (3L, 'n', null), (4L, 'n', null) t(id, name, email)"),
        "jobs": spark.range(3000).select(
            "id", F.lit("t").alias("title"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 9).cast("long").alias("client_id"),
            F.when(F.col("id") < 5, "lost").otherwise("open").alias("status")),
    }
    stored = {}
    for name, df in rows.items():
        df.write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
    report = contract_violations(stored)
    got = {(r["table"], r["rule"]): r["violations"] for r in report.collect()}
    assert _scans(report) == 3
    assert got["clients", "id unique"] == 1 and got["clients", "name not null"] == 1
    assert got["recruiters", "email unique"] == 1 and got["recruiters", "id unique"] == 0
    assert got["jobs", "client_id in clients"] == 1000 and got["jobs", "status in domain"] == 5
    alone = {(r["table"], r["rule"]): r["violations"] for r in contract_violations({"jobs": stored["jobs"]}).collect()}
    assert ("jobs", "client_id in clients") not in alone and alone["jobs", "id unique"] == 0
    empty = contract_violations({k: d.limit(0) for k, d in stored.items()}).collect()
    assert len(empty) == len(got) and not any(r["violations"] for r in empty)


def test_files_of_unsupported_types_are_not_parsed(spark):
    text = "Jane Doe\njane@example.com\nPython"
    files = spark.createDataFrame([("a/x.png", text), ("a/x.pdf", text), ("a/y.PDF", " \n")], "path string, text string")
    got = {r["path"]: r for r in parsing.ingest_files(files, 2026).collect()}
    assert [(got[p]["status"], got[p]["email"], got[p]["skills"]) for p in ("a/x.png", "a/x.pdf", "a/y.PDF")] == [
        ("unsupported", None, None), ("parsed", "jane@example.com", ["Python"]), ("rejected", None, None)]
    assert got["a/x.png"]["text"] == text and set(files.columns) < set(got["a/x.png"].asDict()) and "_decoded" not in got["a/x.png"]


def test_first_embedding_moves_no_text(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    rows = spark.range(50).select("id", F.lit("text").alias("text"))
    todo = rows.join(house.embeddings("candidates").select("id"), "id", "left_anti")
    plan = todo._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and todo.count() == 50
    tables.bucketed(spark, house.root, "candidates").clear()
    assert house.embed_candidates() == 0 and house.embed_candidates() == 0
    assert house.job_timings().agg(F.sum("n_rows")).first()[0] == 0


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_contract_keys_of_any_type_meet_and_are_counted_in_compiled_code(spark, kind):
    stored = {
        "clients": spark.createDataFrame([(1, "a"), (2, None), (2, "c")], "id long, name string"),
        "jobs": spark.createDataFrame([(1, "t", 1), (2, None, 9), (3, "u", None)], "id long, title string, client_id long").withColumn(
            "client_id", F.col("client_id").cast(kind)),
    }
    report = contract_violations(stored)
    assert "ArrayFilter" not in report._jdf.queryExecution().optimizedPlan().toString() and "filter(array" not in report._jdf.queryExecution().toString()
    got = {(r["table"], r["rule"]): r["violations"] for r in report.collect()}
    assert got["clients", "id unique"] == 1 and got["clients", "name not null"] == 1
    assert got["jobs", "client_id in clients"] == 1 and got["jobs", "client_id not null"] == 1 and got["jobs", "title not null"] == 1
    assert got["jobs", "id unique"] == 0
