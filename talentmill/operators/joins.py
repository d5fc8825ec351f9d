"""Joins along the foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# A key is hot if it holds at least this part of all rows; so there are at most as many.
HOT_PARTS = 10_000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of rows to a table with one row per key, which holds the key's row count n.

    Rows of hot keys meet a broadcast of the hot keys' figures where they are: at most
    HOT_PARTS keys can hold 1 / HOT_PARTS of all rows, so its size is bounded whatever
    the data. All other rows are shuffled by key. Spark's own skew handling cannot split
    such a join, because an aggregate on the same key shares its shuffle.
    """
    total = per_key.agg(F.sum(n)).scalar()
    is_hot = F.col(n) * HOT_PARTS >= total
    hot = F.broadcast(per_key.where(is_hot))
    cold_rows = rows.join(F.broadcast(per_key.where(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold_rows.join(per_key.where(~is_hot), key))


def placement_detail(
    placements: DataFrame,
    candidates: DataFrame,
    jobs: DataFrame,
    clients: DataFrame,
    recruiters: DataFrame,
) -> DataFrame:
    """Placements with the names of all linked rows; the recruiter is optional.

    Each dimension is cut to its key and label first. Spark picks broadcast or
    sort-merge by the measured size of each side and splits hot keys at run time.
    """
    def side(df: DataFrame, key: str, label: str, name: str) -> DataFrame:
        return df.select(F.col("id").alias(key), F.col(label).alias(name))

    return (
        placements.join(side(candidates, "candidate_id", "name", "candidate"), "candidate_id")
        .join(side(jobs, "job_id", "title", "job"), "job_id")
        .join(side(clients, "client_id", "name", "client"), "client_id")
        .join(side(recruiters, "recruiter_id", "name", "recruiter"), "recruiter_id", "left")
        .select(
            "id", "candidate_id", "candidate", "job_id", "job", "client_id", "client",
            "recruiter_id", "recruiter", "stage", "bill_rate", "pay_rate", "margin", "submitted_at",
        )
    )


def children_per_parent(children: DataFrame, parents: DataFrame, link: str, counted_as: str) -> DataFrame:
    """Number of child rows per parent row, zero included.

    Counts per key are taken before the join, so a hot key is one row there.
    """
    counts = children.groupBy(link).agg(F.count("*").alias(counted_as))
    return parents.select("id").join(counts, F.col("id") == F.col(link), "left").select(
        "id", F.coalesce(F.col(counted_as), F.lit(0)).alias(counted_as)
    )
