"""Funnel, revenue, margin and latency aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import micros, money, rounded_ratio
from ..session import materialise
from .joins import join_per_key
from .ranks import stats_with_nth
from .scans import equals


def placement_funnel_counts(placements: DataFrame, client_id: int | None = None) -> DataFrame:
    """Placements per stage; stages without rows are absent."""
    return equals(placements, client_id=client_id).groupBy("stage").agg(F.count("id").alias("count"))


def monthly_revenue(payroll: DataFrame) -> DataFrame:
    """Sum of bill rates and number of payroll rows per month, in month order."""
    month = F.trunc("period", "MM").alias("month")
    return (
        payroll.groupBy(month)
        .agg(
            F.sum(money(F.col("bill_rate"))).cast("double").alias("revenue"),
            F.count("contractor_id").alias("headcount"),
        )
        .orderBy("month")
    )


def monthly_headcount_distinct(payroll: DataFrame) -> DataFrame:
    """Number of different contractors per month."""
    month = F.trunc("period", "MM").alias("month")
    return payroll.groupBy(month).agg(F.countDistinct("contractor_id").alias("contractors"))


def margin_leakage_clients(clients: DataFrame, threshold: float = 15.0) -> DataFrame:
    """Clients whose stored margin percentage is below the threshold."""
    return clients.where(F.col("margin_pct") < threshold).select("id", "name", "margin_pct")


def margin_leakage(
    payroll: DataFrame,
    candidates: DataFrame,
    placements: DataFrame,
    clients: DataFrame,
    threshold: float = 15.0,
    dedup: bool = False,
) -> DataFrame:
    """Clients whose contractors' average payroll margin is below the threshold.

    By definition every payroll row counts once per placement of its contractor at
    the client (dedup=False), or once per contractor and client (dedup=True). Both
    sides are reduced to one row per key before they meet, so the many-to-many join
    never multiplies rows: the placement count becomes a weight on the payroll sums.
    """
    pay = payroll.groupBy("contractor_id").agg(
        F.sum(money(F.col("margin_pct"))).cast("decimal(27,2)").alias("pct_sum"),
        F.sum(money(F.col("bill_rate"))).cast("decimal(27,2)").alias("bill_sum"),
        F.count("margin_pct").alias("n"),
    )
    weight = F.lit(1) if dedup else F.count("*")
    # Both are read several times below, so each is written once.
    pairs = materialise(placements.groupBy("candidate_id", "client_id").agg(
        weight.cast("decimal(10,0)").alias("w")
    ), "candidate-client")
    per_candidate = (
        pairs.groupBy("candidate_id").agg(F.count("*").alias("links"))
        .join(pay, F.col("candidate_id") == F.col("contractor_id"))
        .join(candidates.select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi")
        .drop("contractor_id")
    )
    per_candidate = materialise(per_candidate, "per-candidate")
    per_client = join_per_key(pairs, per_candidate, "candidate_id", "links").groupBy("client_id").agg(
        F.sum(F.col("w") * F.col("pct_sum")).alias("pct_sum"),
        F.sum(F.col("w") * F.col("bill_sum")).alias("bill_sum"),
        F.sum(F.col("w") * F.col("n")).alias("n"),
    )
    average = F.col("pct_sum").cast("double") / F.col("n").cast("double")
    return (
        per_client.withColumn("avg_margin_pct", average)
        .where(F.col("avg_margin_pct") < threshold)
        .join(clients.select("id", "name"), F.col("client_id") == F.col("id"))
        .select("id", "name", "avg_margin_pct", F.col("bill_sum").cast("double").alias("total_revenue"))
    )


def latency_stats(
    samples: DataFrame, quantile: float = 0.95, min_samples: int = 20
) -> DataFrame:
    """Calls, average, extremes, total and p95 per operation over (operation, elapsed_ms).

    p95 is the sample at the zero-based rank floor(n * 0.95) of the ascending order,
    null below min_samples. Milliseconds have two decimals, total seconds three.
    """
    rows = samples.select("operation", "elapsed_ms").where(F.col("elapsed_ms").isNotNull())
    total = F.sum(micros(F.col("elapsed_ms")))
    one = F.lit(1000000).cast("decimal(20,0)")
    ranked = stats_with_nth(
        rows, "operation", "elapsed_ms",
        rank=lambda n: F.floor(n * F.lit(quantile)) + 1,
        near=quantile, min_rows=min_samples,
        stats=[
            F.count("*").alias("calls"),
            total.alias("total"),
            F.min(micros(F.col("elapsed_ms"))).alias("low"),
            F.max(micros(F.col("elapsed_ms"))).alias("high"),
        ],
    )
    return ranked.select(
        "operation",
        "calls",
        rounded_ratio(F.col("total"), one * F.col("calls"), 2).alias("avg_ms"),
        rounded_ratio(F.col("low"), one, 2).alias("min_ms"),
        rounded_ratio(F.col("high"), one, 2).alias("max_ms"),
        rounded_ratio(F.col("total"), one * 1000, 3).alias("total_s"),
        rounded_ratio(micros(F.col("nth_value")), one, 2).alias("p95_ms"),
    )


def outcome_counts(parsed: DataFrame) -> DataFrame:
    """Number of rows per outcome of a batch."""
    return parsed.groupBy("status").agg(F.count("*").alias("files"))


def active_contractors(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("is_active_contractor")).alias("active_contractors"),
    )


def skill_frequency(parsed: DataFrame) -> DataFrame:
    """Number of resumes per skill.

    The outer form keeps the optimizer from adding a filter that would evaluate the
    skill rules a second time.
    """
    return (
        parsed.select(F.explode_outer("skills").alias("skill"))
        .where(F.col("skill").isNotNull())
        .groupBy("skill")
        .agg(F.count("*").alias("resumes"))
    )


def weekly_hours(timesheets: DataFrame) -> DataFrame:
    """Hours and overtime per contractor and ISO week."""
    return timesheets.groupBy("contractor_id", "week_start").agg(
        F.sum(money(F.col("hours"))).cast("double").alias("hours"),
        F.sum(money(F.col("overtime_hours"))).cast("double").alias("overtime_hours"),
        F.count("*").alias("sheets"),
    )
