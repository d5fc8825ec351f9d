"""Derived measures: margins, overtime, calendar keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL_WEEK = 40


def margin_columns(bill_rate: Column, pay_rate: Column) -> tuple[Column, Column]:
    """margin and margin_pct (percent, one decimal); the percentage is null for a zero bill rate."""
    bill, pay = bill_rate.cast("decimal(18,4)"), pay_rate.cast("decimal(18,4)")
    pct = F.round((bill - pay) * 100 / F.nullif(bill, F.lit(0).cast("decimal(18,4)")), 1)
    return (bill - pay).cast("double").alias("margin"), pct.cast("double").alias("margin_pct")


def with_margins(df: DataFrame) -> DataFrame:
    margin, pct = margin_columns(F.col("bill_rate"), F.col("pay_rate"))
    return df.withColumns({"margin": margin, "margin_pct": pct})


def overtime(hours: Column) -> Column:
    """Hours beyond a full week, one decimal."""
    over = hours.cast("decimal(18,4)") - FULL_WEEK
    return F.round(F.greatest(over, F.lit(0).cast("decimal(18,4)")), 1).cast("double")


def week_start(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", day).cast("date")


def pay_period(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "MM")
