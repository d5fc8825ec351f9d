"""Batch inserts and keyed updates.

Parquet has no row update: the keyed updates return the new version of the table,
which the caller writes over the affected partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STAGES, Table


def assign_ids(batch: DataFrame, natural_key: str, start: int | Column = 0, hex_digits: int = 3) -> DataFrame:
    """Adds a dense id: start + 1, start + 2, ... over the batch.

    Rows fall into 16 ** hex_digits buckets by a hash of the natural key, which must be
    unique. A running count over the buckets (one row each) gives every bucket its
    offset; rows are numbered inside their bucket. No task sees more than its buckets,
    and the ids depend on the rows alone, so a recomputed partition gets the same ones.
    """
    keyed = batch.withColumn("_bucket", F.substring(F.md5(F.col(natural_key).cast("string")), 1, hex_digits))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(natural_key)
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        keyed.withColumn("_row", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn("id", (first + F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_offset")
    )


def with_defaults(batch: DataFrame, table: Table) -> DataFrame:
    """The batch in table column order, with defaults for empty and absent columns."""
    have = set(batch.columns)
    out = []
    for field in table.schema.fields:
        given = F.col(field.name) if field.name in have else F.lit(None)
        if field.name in table.defaults:
            given = F.coalesce(given, F.expr(table.defaults[field.name]))
        out.append(given.cast(field.dataType).alias(field.name))
    return batch.select(*out)


def prediction_rows(scored: DataFrame, model_name: str, features: list[str]) -> DataFrame:
    """Prediction rows from a scored table (entity_type, entity_id, score, features...)."""
    packed = F.to_json(F.struct(*features)) if features else F.lit(None).cast("string")
    return scored.select(
        "entity_type", "entity_id", F.lit(model_name).alias("model_name"), "score",
        packed.alias("features"),
    )


def net_changes(changes: DataFrame, fields: list[str], key: str = "id", order: tuple[str, ...] = ("changed_at", "seq")) -> DataFrame:
    """One row per key: for every field, whether it was set and its last value.

    A change row carries set_fields, the names of the fields it sets; so a field can be
    set to null. max_by combines on the map side, whatever the number of changes per key.
    """
    at = F.struct(*order)
    out = []
    for name in fields:
        given = F.array_contains("set_fields", name)
        out.append(F.max_by(F.col(name), F.when(given, at)).alias(f"_new_{name}"))
        out.append(F.coalesce(F.bool_or(given), F.lit(False)).alias(f"_set_{name}"))
    return changes.groupBy(key).agg(*out, F.max(order[0]).alias("_changed_at"))


def apply_changes(df: DataFrame, changes: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The table after a batch of keyed changes; updated_at moves on changed rows."""
    net = net_changes(changes, fields, key).withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    updates = {
        name: F.when(F.col(f"_set_{name}"), F.col(f"_new_{name}")).otherwise(F.col(name))
        for name in fields
    }
    if "updated_at" in df.columns:
        updates["updated_at"] = F.when(hit, F.col("_changed_at")).otherwise(F.col("updated_at"))
    return df.join(net, key, "left").withColumns(updates).select(*df.columns)


def unmatched_changes(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Change rows whose key has no row: the rejects of apply_changes."""
    return changes.join(df.select(key), key, "left_anti")


def change_stages(placements: DataFrame, changes: DataFrame) -> DataFrame:
    """Placements after stage changes (id, stage, changed_at, seq) of known stages."""
    valid = changes.where(F.col("stage").isin(*STAGES)).withColumn("set_fields", F.array(F.lit("stage")))
    return apply_changes(placements, valid, ["stage"])


def rejected_stages(placements: DataFrame, changes: DataFrame) -> DataFrame:
    """Stage changes that cannot be applied, with the reason."""
    known = F.col("stage").isin(*STAGES)
    bad = changes.where(~F.coalesce(known, F.lit(False))).withColumn("reason", F.lit("invalid stage"))
    lost = unmatched_changes(placements, changes.where(known)).withColumn("reason", F.lit("unknown id"))
    return bad.unionByName(lost)


def _targets(df: DataFrame, key: str = "id") -> DataFrame:
    """How many rows each key has; a keyed update needs exactly one."""
    return df.groupBy(key).agg(F.count("*").alias("_rows"))


def flag_anomalies(timesheets: DataFrame, findings: DataFrame) -> DataFrame:
    """Timesheets with findings (id, score, reason) applied: flagged, scored, explained.

    Of several findings for a sheet the highest score counts. Findings that match no sheet, or
    more than one, change nothing: rejected_findings returns them.
    """
    best = findings.groupBy("id").agg(F.max(F.struct("score", "reason")).alias("_f"))
    # The join has the rows of an id together and in order, so they are counted there.
    hit = F.col("_f").isNotNull() & (F.col("_rows") == 1)
    return (
        timesheets.join(best, "id", "left")
        .withColumn("_rows", F.count("*").over(Window.partitionBy("id")))
        .withColumns({
            "anomaly_flag": F.when(hit, F.lit(True)).otherwise(F.col("anomaly_flag")),
            "anomaly_score": F.when(hit, F.col("_f.score")).otherwise(F.col("anomaly_score")),
            "anomaly_reason": F.when(hit, F.col("_f.reason")).otherwise(F.col("anomaly_reason")),
            "status": F.when(hit, F.lit("flagged")).otherwise(F.col("status")),
        })
        .select(*timesheets.columns)
    )


def rejected_findings(timesheets: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings that flag_anomalies cannot apply, with `rejected`: unknown id or ambiguous id."""
    found = findings.join(_targets(timesheets), "id", "left")
    why = F.when(F.col("_rows").isNull(), F.lit("unknown id")).when(F.col("_rows") > 1, F.lit("ambiguous id"))
    return found.withColumn("rejected", why).where(F.col("rejected").isNotNull()).select(*findings.columns, "rejected")
