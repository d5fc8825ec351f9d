"""Order statistics and latency figures against plain Python."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talentmill.operators.aggregates import latency_stats
from talentmill.operators.ranks import nth_value


def p95(samples):
    return sorted(samples)[int(len(samples) * 0.95)] if len(samples) >= 20 else None


@pytest.mark.parametrize("n, index", [(20, 19), (40, 38), (60, 57), (100, 95)])
def test_rank_of_p95(spark, n, index):
    rows = spark.range(n).select(F.lit("op").alias("operation"), F.col("id").cast("double").alias("elapsed_ms"))
    assert latency_stats(rows).first()["p95_ms"] == index


def test_below_twenty_samples_there_is_no_p95(spark):
    rows = spark.range(19).select(F.lit("op").alias("operation"), F.col("id").cast("double").alias("elapsed_ms"))
    assert latency_stats(rows).first()["p95_ms"] is None


def test_hot_operation_and_ties(spark):
    random.seed(7)
    data = [("hot", random.choice([1.25, 3.5, 8.75])) for _ in range(3000)]
    data += [("wide", round(random.expovariate(0.01), 2)) for _ in range(2000)]
    data += [(f"op{i % 30}", round(random.random() * 100, 2)) for i in range(1500)]
    rows = spark.createDataFrame(data, "operation string, elapsed_ms double").repartition(13)
    want = {}
    for op, ms in data:
        want.setdefault(op, []).append(ms)
    got = {r["operation"]: r for r in latency_stats(rows).collect()}
    assert set(got) == set(want)
    for op, samples in want.items():
        r = got[op]
        assert (r["calls"], r["p95_ms"], r["min_ms"], r["max_ms"]) == (
            len(samples), p95(samples), min(samples), max(samples)
        )
        assert r["avg_ms"] == pytest.approx(sum(samples) / len(samples), abs=0.00501)
        assert r["total_s"] == pytest.approx(sum(samples) / 1000, abs=0.000501)


@pytest.mark.parametrize("near", [0.0, 0.5, 0.95, 1.0])
def test_exact_however_bad_the_splitters(spark, near):
    """The counts, not the sketch, decide: any guess of the position gives the same value."""
    rows = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    got = nth_value(rows, "g", "v", rank=lambda n: F.lit(951), near=near, accuracy=100)
    assert [tuple(r) for r in got.collect()] == [(1, 950.0)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 100000).map(lambda i: i / 100), min_size=1, max_size=80))
def test_random_samples(spark, samples):
    rows = spark.createDataFrame([("op", s) for s in samples], "operation string, elapsed_ms double")
    assert latency_stats(rows).first()["p95_ms"] == p95(samples)


def test_robust_findings_are_not_moved_by_the_outlier(spark):
    from talentmill.plans.insights import robust_findings
    hours = {1: [40.0, 41, 39, 40, 42, 38, 40, 95], 2: [8.0, 8, 8, 8, 60], 3: [20.0], 4: [10.0, 20, 30, 40], 5: [None, 40.0, 44, 48, 90]}
    hours = {k: [h if h is None else float(h) for h in values] for k, values in hours.items()}
    rows = [(k * 100 + i, k, h) for k, values in hours.items() for i, h in enumerate(values)] + [(999, None, 70.0)]
    got = {r.id: r for r in robust_findings(spark.createDataFrame(rows, "id long, contractor_id long, hours double"), 3.5).collect()}
    want = {}
    for k, values in hours.items():
        known = sorted(h for h in values if h is not None)
        median = known[(len(known) + 1) // 2 - 1]
        mad = sorted(abs(h - median) for h in known)[(len(known) + 1) // 2 - 1]
        want |= {k * 100 + i: round((h - median) / (1.4826 * mad), 6) for i, h in enumerate(values)
                 if h is not None and mad and (h - median) / (1.4826 * mad) >= 3.5}
    assert {i: r.robust_score for i, r in got.items()} == want and 107 in want and 504 in want
