"""Filtered scans of the domain tables. Filters and columns reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import JOB_STATUSES, STAGES, check_domain

CANDIDATE_COLUMNS = (
    "id", "name", "email", "skills", "visa_status", "location", "yoe", "rate",
    "is_active_contractor", "attrition_risk_score", "resume_path", "created_at",
)
JOB_COLUMNS = (
    "id", "title", "client_id", "required_skills", "location", "remote_ok", "rate_min",
    "rate_max", "visa_requirement", "min_yoe", "max_yoe", "status", "created_at",
)
CLIENT_COLUMNS = (
    "id", "name", "industry", "status", "req_volume", "margin_pct", "contact_name",
    "contact_email", "created_at",
)
RECRUITER_COLUMNS = ("id", "name", "email", "team", "created_at")
PLACEMENT_COLUMNS = (
    "id", "candidate_id", "job_id", "recruiter_id", "client_id", "stage", "match_score",
    "skill_gap", "bill_rate", "pay_rate", "margin", "submitted_at", "updated_at",
)
TIMESHEET_COLUMNS = (
    "id", "contractor_id", "week_start", "hours", "overtime_hours", "status", "anomaly_flag",
    "anomaly_score", "anomaly_reason", "created_at",
)
PAYROLL_COLUMNS = (
    "id", "contractor_id", "period", "bill_rate", "pay_rate", "margin", "margin_pct", "created_at",
)
PREDICTION_COLUMNS = (
    "id", "entity_type", "entity_id", "model_name", "score", "features", "created_at",
)


def project(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """The listed columns that exist, in listed order."""
    have = set(df.columns)
    return df.select(*[c for c in columns if c in have])


def equals(df: DataFrame, **filters: object) -> DataFrame:
    """Equality filters; None means no filter. Zero is a key like any other."""
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def is_true(df: DataFrame, column: str) -> DataFrame:
    """Rows whose flag is true; null is not true."""
    return df.where(F.col(column).eqNullSafe(F.lit(True)))


def get_candidates(candidates: DataFrame, active_only: bool = False) -> DataFrame:
    rows = is_true(candidates, "is_active_contractor") if active_only else candidates
    return project(rows, CANDIDATE_COLUMNS)


def get_jobs(jobs: DataFrame, status: str | None = None) -> DataFrame:
    check_domain(status, JOB_STATUSES, "job status")
    return project(equals(jobs, status=status), JOB_COLUMNS)


def get_open_jobs(jobs: DataFrame) -> DataFrame:
    return get_jobs(jobs, "open")


def get_clients(clients: DataFrame) -> DataFrame:
    return project(clients, CLIENT_COLUMNS)


def get_recruiters(recruiters: DataFrame) -> DataFrame:
    return project(recruiters, RECRUITER_COLUMNS)


def get_placements(
    placements: DataFrame,
    client_id: int | None = None,
    recruiter_id: int | None = None,
    stage: str | None = None,
) -> DataFrame:
    check_domain(stage, STAGES, "placement stage")
    rows = equals(placements, client_id=client_id, recruiter_id=recruiter_id, stage=stage)
    return project(rows, PLACEMENT_COLUMNS)


def get_timesheets(
    timesheets: DataFrame, contractor_id: int | None = None, flagged_only: bool = False
) -> DataFrame:
    rows = equals(timesheets, contractor_id=contractor_id)
    if flagged_only:
        rows = is_true(rows, "anomaly_flag")
    return project(rows, TIMESHEET_COLUMNS)


def get_payroll(payroll: DataFrame, contractor_id: int | None = None) -> DataFrame:
    return project(equals(payroll, contractor_id=contractor_id), PAYROLL_COLUMNS)


def get_latest_predictions(
    predictions: DataFrame, model_name: str, entity_type: str | None = None
) -> DataFrame:
    """All predictions of a model, newest first, undated ones in front.

    The id breaks ties, so that a pile of equal or missing times is still cut into
    several sort ranges.
    """
    rows = equals(predictions, model_name=model_name, entity_type=entity_type)
    return project(rows, PREDICTION_COLUMNS).orderBy(F.desc_nulls_first("created_at"), F.desc("id"))


def newest_per_entity(predictions: DataFrame, model_name: str | None = None) -> DataFrame:
    """The newest dated prediction per entity and model, ties to the larger id.

    A max over a struct combines on the map side, so a hot entity costs one row per
    input partition; a window would gather all its rows in one task.
    """
    rows = equals(predictions, model_name=model_name).where(F.col("created_at").isNotNull())
    newest = F.max(F.struct("created_at", "id", "score", "features"))
    return (
        rows.groupBy("entity_type", "entity_id", "model_name")
        .agg(newest.alias("p"))
        .select("p.id", "entity_type", "entity_id", "model_name", "p.score", "p.features", "p.created_at")
    )


def by_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the key table: the bulk form of a lookup by id."""
    return df.join(keys.select(key), key, "left_semi")


def missing_keys(keys: DataFrame, df: DataFrame, key: str = "id") -> DataFrame:
    """Keys without a row."""
    return keys.select(key).distinct().join(df.select(key), key, "left_anti")
