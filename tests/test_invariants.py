"""Properties that hold whatever the data: partition independence, totals, skew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from talentmill.operators import aggregates, scans, writes
from talentmill.operators.quality import contract_violations
from talentmill.plans import insights
from talentmill.sources import star_views as v


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    "job",
    [
        lambda p, t, k: aggregates.monthly_revenue(p),
        lambda p, t, k: aggregates.weekly_hours(t),
        lambda p, t, k: insights.timesheet_findings(t, 1.5),
        lambda p, t, k: insights.revenue_forecast(p),
        lambda p, t, k: aggregates.latency_stats(t.select(F.col("status").alias("operation"), F.col("hours").alias("elapsed_ms"))),
        lambda p, t, k: aggregates.margin_leakage(p, k, p.select(F.col("contractor_id").alias("candidate_id"), F.col("id").alias("client_id")), k, 99),
    ],
    ids=["revenue", "hours", "findings", "forecast", "latency", "leakage"],
)
def test_results_do_not_depend_on_partitions(spark, small_dir, job):
    p, t, k = v.payroll(spark, small_dir), v.timesheets(spark, small_dir), v.candidates(spark, small_dir)
    want = rows_of(job(p, t, k))
    for n in (1, 7, 64):
        assert rows_of(job(p.repartition(n), t.repartition(n), k.repartition(n))) == want


def test_funnel_totals(spark, small_dir):
    placements = v.placements(spark, small_dir)
    total = placements.count()
    assert aggregates.placement_funnel_counts(placements).agg(F.sum("count")).first()[0] == total
    assert insights.funnel_conversion(placements).agg(F.sum("count")).first()[0] == total
    assert placements.select("id").distinct().count() == total


@pytest.mark.parametrize("dedup", [False, True])
def test_weighted_leakage_equals_naive_join_with_a_hot_contractor(spark, dedup):
    """Half of all payroll and placement rows belong to one contractor."""
    hot = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 7)
    payroll = spark.range(300).select(
        hot.alias("contractor_id"), (F.col("id") % 23).cast("double").alias("margin_pct"), F.lit(10.5).alias("bill_rate")
    )
    placements = spark.range(200).select(hot.alias("candidate_id"), (F.col("id") % 5).alias("client_id"))
    people = spark.range(7).select("id", F.col("id").cast("string").alias("name"))
    got = aggregates.margin_leakage(payroll, people, placements, people, 12.0, dedup)
    links = placements.distinct() if dedup else placements
    naive = (
        payroll.join(links, F.col("contractor_id") == F.col("candidate_id"))
        .groupBy("client_id").agg(F.avg("margin_pct").alias("a"), F.sum("bill_rate").alias("b")).where("a < 12")
    )
    want = {r["client_id"]: (round(r["a"], 9), r["b"]) for r in naive.collect()}
    assert {r["id"]: (round(r["avg_margin_pct"], 9), r["total_revenue"]) for r in got.collect()} == want


def test_zero_is_a_key_and_null_is_not_true(spark):
    rows = spark.sql("select * from values (0L, true), (1L, null), (2L, false) t(contractor_id, anomaly_flag)")
    assert scans.get_timesheets(rows, contractor_id=0).count() == 1
    assert scans.get_timesheets(rows, flagged_only=True).count() == 1
    assert scans.get_timesheets(rows).count() == 3


def test_last_change_per_field_wins(spark):
    changes = spark.sql("""
        select * from values
          (1L, timestamp'2024-01-02', 1, array('a'), 'late', null),
          (1L, timestamp'2024-01-01', 9, array('a', 'b'), 'early', 'kept'),
          (1L, timestamp'2024-01-03', 1, array(), 'ignored', 'ignored')
        as t(id, changed_at, seq, set_fields, a, b)""")
    rows = spark.sql("select 1L id, 'x' a, 'y' b union all select 2L, 'x', 'y'")
    got = writes.apply_changes(rows, changes, ["a", "b"])
    assert sorted(map(tuple, got.collect())) == [(1, "late", "kept"), (2, "x", "y")]


def test_only_the_sheet_with_a_finding_is_flagged(spark):
    sheets = spark.sql("""
        select * from values (1L, 7L, 'approved', false, null, null), (2L, 7L, 'approved', false, null, null),
          (3L, 8L, 'approved', false, null, null), (3L, 9L, 'approved', false, null, null)
        as t(id, contractor_id, status, anomaly_flag, anomaly_score, anomaly_reason)""")
    findings = spark.createDataFrame([(1, 0.5, "low"), (1, 0.9, "high"), (3, 1.0, "whose?"), (4, 1.0, "lost")], "id long, score double, reason string")
    got = writes.flag_anomalies(sheets, findings).where("anomaly_flag").collect()
    assert [(r["id"], r["status"], r["anomaly_score"], r["anomaly_reason"]) for r in got] == [(1, "flagged", 0.9, "high")]
    lost = writes.rejected_findings(sheets, findings).collect()
    assert sorted((r["id"], r["rejected"]) for r in lost) == [(3, "ambiguous id"), (4, "unknown id")]


def test_views_read_all_lines_under_unique_ids(spark, small_dir):
    lines = v.table(spark, small_dir, "lineitem")
    orders = v.table(spark, small_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").count()
    assert v.placements(spark, small_dir).count() == orders
    hours = lines.agg(F.sum("l_quantity")).first()[0]
    for view in (v.timesheets, v.payroll):
        rows = view(spark, small_dir)
        assert rows.select("id").distinct().count() == rows.count()
    assert v.timesheets(spark, small_dir).agg(F.sum("hours")).first()[0] == hours


def test_violations_count_rows(spark):
    clients = spark.sql("select * from values (1L, 'a'), (1L, 'b'), (2L, null) t(id, name)")
    jobs = spark.sql("select * from values (1L, 't', 1L, 'open'), (2L, 't', 9L, 'x'), (3L, 't', 9L, null) t(id, title, client_id, status)")
    got = {(r["table"], r["rule"]): r["violations"] for r in contract_violations({"clients": clients, "jobs": jobs}).collect()}
    found = {k: n for k, n in got.items() if n}
    assert found == {
        ("clients", "name not null"): 1, ("clients", "id unique"): 1,
        ("jobs", "client_id in clients"): 2, ("jobs", "status in domain"): 1,
    }


def test_filters_reach_the_scan(spark, small_dir):
    plan = scans.get_payroll(v.payroll(spark, small_dir), 5)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan
    plan = v.clients(spark, small_dir).where("id = 5").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,5)" in plan and "c_mktsegment" not in plan


@pytest.mark.parametrize("parts", [1, 3, 10_000])
def test_hot_and_cold_keys_join_alike(spark, monkeypatch, parts):
    """Whatever counts as hot, the union of both ways is the plain join."""
    from talentmill.operators import joins

    monkeypatch.setattr(joins, "HOT_PARTS", parts)
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 11)
    rows = spark.range(400).select("id", F.when(F.col("id") != 7, key).alias("k"))
    per_key = rows.where("k <> 5").groupBy("k").agg(F.count("*").alias("n"))
    want = rows_of(rows.join(per_key, "k").select("id", "k", "n"))
    assert rows_of(joins.join_per_key(rows, per_key, "k", "n").select("id", "k", "n")) == want
    assert joins.join_per_key(rows, per_key.where("n < 0"), "k", "n").count() == 0


@pytest.mark.parametrize("view", [v.payroll, v.timesheets, v.placements])
def test_order_lines_move_before_they_are_grouped(spark, small_dir, view):
    """Keys are nearly as many as lines: grouping whole splits before the shuffle would only sort and spill them."""
    plan = view.__wrapped__(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):plan.index("lineitem.parquet")]
    assert "Aggregate" in plan and "Aggregate" not in below[below.rindex("Exchange"):]


def test_leakage_groups_its_inputs_once(spark, small_dir):
    """The sides that are read several times are written; the final plan reads neither placements nor payroll again."""
    pay, placed = v.payroll(spark, small_dir), v.placements(spark, small_dir)
    plan = aggregates.margin_leakage(pay, v.candidates(spark, small_dir), placed, v.clients(spark, small_dir), 99)
    files = plan.inputFiles()
    assert files and not set(files) & {*pay.inputFiles(), *placed.inputFiles()}


def test_robust_findings_move_no_sheets_to_few_contractors(spark):
    sheets = spark.range(4000).select("id", (F.col("id") % 40).alias("contractor_id"), (F.col("id") * 7919 % 61).cast("double").alias("hours"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        found = insights.robust_findings(sheets, 1.0)
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
        assert found.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_flags_read_the_sheets_once_and_count_ids_where_they_join(spark):
    sheets = spark.createDataFrame(
        [(1, "approved", None, None, None), (2, "approved", None, None, None), (2, "approved", False, 0.5, "old"), (None, "approved", None, None, None)],
        "id long, status string, anomaly_flag boolean, anomaly_score double, anomaly_reason string")
    findings = spark.createDataFrame(
        [(1, 2.0, "a"), (1, 3.0, "b"), (2, 9.0, "c"), (None, 9.0, "d"), (7, 9.0, "e")], "id long, score double, reason string")
    flagged = writes.flag_anomalies(sheets, findings)
    assert flagged._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 and flagged.columns == sheets.columns
    assert sorted(map(tuple, flagged.collect()), key=str) == sorted([
        (1, "flagged", True, 3.0, "b"), (2, "approved", None, None, None), (2, "approved", False, 0.5, "old"), (None, "approved", None, None, None)], key=str)
