"""Exact order statistics per group without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .joins import join_per_key


def stats_with_nth(
    df: DataFrame,
    group: str,
    value: str,
    rank: Callable[[Column], Column],
    near: float,
    min_rows: int = 1,
    stats: Sequence[Column] = (),
    accuracy: int = 100_000,
) -> DataFrame:
    """(group, stats..., nth_value): aggregates of each group and the value at a one-based rank of its ascending order.

    rank maps the group's row count to the wanted rank; near is about its relative position; null values take no part,
    and a group with fewer than min_rows values has a null nth_value. There are two passes (the second with
    a branch for hot groups and one for all others). The first takes the aggregates and, from a mergeable quantile sketch, two splitters around the rank. The second reduces each
    group to one count below, one count above and a count per value between the splitters: about
    6 / accuracy of the group's rows, and the only values that are ordered. The counts show where the rank
    lies, so the result is exact for any splitters; groups that these miss are read once more, ordered by (value, count) on the missed
    side. Both passes combine on the map side and large groups are joined by broadcast, so a group with most of the
    rows spreads over all tasks. What the passes leave is written to the shared folder.
    """
    rows = df.where(F.col(value).isNotNull())
    slack = 3.0 / accuracy
    cuts = [max(near - slack, 0.0), min(near + slack, 1.0)]
    first = materialise(
        rows.groupBy(group).agg(
            F.count("*").alias("_n"), F.percentile_approx(value, cuts, accuracy).alias("_cuts"), *stats
        ).withColumn("_rank", rank(F.col("_n")).cast("long")), "splitters")
    wanted = first.where(F.col("_n") >= min_rows).select(
        group, "_n", "_rank", F.col("_cuts")[0].alias("_low"), F.col("_cuts")[1].alias("_high"))
    slim = rows.select(group, value)
    part = F.when(F.col(value) < F.col("_low"), 0).when(F.col(value) <= F.col("_high"), 1).otherwise(2)
    reduced = materialise(
        join_per_key(slim, wanted, group, "_n")
        .select(group, "_rank", part.alias("_part"), F.when(part == 1, F.col(value)).alias(value))
        .groupBy(group, "_part", value).agg(F.count("*").alias("_count"), F.first("_rank").alias("_rank")), "ranges")
    in_order = Window.partitionBy(group).orderBy("_part", value).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("_reached")
    holds = reduced.withColumn("_reached", F.sum("_count").over(in_order)).where(
        (reached >= F.col("_rank")) & (reached - F.col("_count") < F.col("_rank")))
    found = holds.where("_part = 1").select(group, F.col(value).alias("nth_value"))
    missed = holds.where("_part <> 1").select(
        group, F.col("_part").alias("_side"), (F.col("_rank") - reached + F.col("_count")).alias("_rest"))
    if not missed.isEmpty():
        side = join_per_key(slim, wanted.join(missed, group), group, "_n").where(part == F.col("_side"))
        counts = side.groupBy(group, value).agg(F.count("*").alias("_count"), F.first("_rest").alias("_rest"))
        by_value = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_reached", F.sum("_count").over(by_value))
        found = found.union(
            counts.where((reached >= F.col("_rest")) & (reached - F.col("_count") < F.col("_rest")))
            .select(group, F.col(value).alias("nth_value")))
    return first.drop("_n", "_cuts", "_rank").join(found, group, "left")


def nth_value(
    df: DataFrame, group: str, value: str, rank: Callable[[Column], Column], near: float, min_rows: int = 1, accuracy: int = 100_000,
) -> DataFrame:
    """(group, nth_value) of the groups with at least min_rows values; see stats_with_nth."""
    return stats_with_nth(df, group, value, rank, near, min_rows, accuracy=accuracy).where(F.col("nth_value").isNotNull())
