"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node reachable), for every node that has an edge.

    Every round hangs each node's larger neighbours, then its smaller ones, under the smallest
    node in reach; after a few rounds only stars are left. Rounds are joins and
    aggregates with map-side combination, and end when the edges stop changing.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, "components")
    before = None
    while (now := _state(pairs)) != before:
        before = now
        both = pairs.select("u", "v").union(pairs.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select("v", "low").where("v <> low").union(low.select("u", "low"))
        pairs = stored(small.toDF("u", "v").distinct(), "components")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select("v", "v").distinct()).toDF("node", "component")
