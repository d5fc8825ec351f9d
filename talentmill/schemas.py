"""Domain tables: schemas, value domains, defaults, keys and links."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The domains of the status columns.
ROLES = ("recruiter", "manager", "exec", "compliance")
VISA_STATUSES = ("citizen", "gc", "h1b", "opt", "stem_opt", "ead", "other", "unknown")
JOB_STATUSES = ("open", "on_hold", "filled", "closed")
STAGES = ("submitted", "interview", "offer", "hire", "rejected")
TIMESHEET_STATUSES = ("pending", "approved", "rejected", "flagged")

EMBEDDING_DIM = 384
VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
STRINGS = T.ArrayType(T.StringType())


@dataclass(frozen=True)
class Table:
    """Contract of one table.

    max_length, domains and links are keyed by column; defaults hold SQL expressions
    that fill a column left empty at insert.
    """

    schema: T.StructType
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ("id",)
    max_length: dict[str, int] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    links: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()


TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "array<string>": STRINGS, "vector": VECTOR,
}


def columns(**types: str) -> T.StructType:
    """Schema from column names and type names, without a session."""
    return T.StructType([T.StructField(name, TYPES[t]) for name, t in types.items()])


NOW = "current_timestamp()"

TABLES: dict[str, Table] = {
    "users": Table(
        columns(
            id="long", username="string", name="string", email="string", role="string",
            is_active="boolean", created_at="timestamp", updated_at="timestamp",
        ),
        required=("username", "name", "email", "role"),
        unique=("id", "username", "email"),
        max_length={"username": 64, "name": 128, "email": 256},
        domains={"role": ROLES},
        defaults={"role": "'recruiter'", "is_active": "true", "created_at": NOW, "updated_at": NOW},
    ),
    "clients": Table(
        columns(
            id="long", name="string", industry="string", contact_name="string",
            contact_email="string", status="string", req_volume="int", margin_pct="double",
            created_at="timestamp", updated_at="timestamp",
        ),
        required=("name",),
        max_length={
            "name": 256, "industry": 128, "contact_name": 128, "contact_email": 256, "status": 32,
        },
        defaults={
            "status": "'active'", "req_volume": "0", "margin_pct": "0D",
            "created_at": NOW, "updated_at": NOW,
        },
    ),
    "recruiters": Table(
        columns(
            id="long", name="string", email="string", team="string", user_id="long",
            created_at="timestamp",
        ),
        required=("name", "email"),
        unique=("id", "email"),
        max_length={"name": 128, "email": 256, "team": 64},
        links={"user_id": "users"},
        defaults={"created_at": NOW},
    ),
    "candidates": Table(
        columns(
            id="long", name="string", email="string", phone="string", skills="array<string>",
            visa_status="string", location="string", yoe="double", rate="double",
            resume_path="string", resume_text="string",
        )
        .add("embedding", VECTOR)
        .add("is_active_contractor", T.BooleanType())
        .add("tenure_days", T.IntegerType())
        .add("comms_gap_days", T.IntegerType())
        .add("overtime_pct", T.DoubleType())
        .add("client_feedback_score", T.DoubleType())
        .add("attrition_risk_score", T.DoubleType())
        .add("created_at", T.TimestampType())
        .add("updated_at", T.TimestampType()),
        required=("name",),
        max_length={"name": 128, "email": 256, "phone": 32, "location": 128, "resume_path": 512},
        domains={"visa_status": VISA_STATUSES},
        defaults={
            "skills": "array()", "visa_status": "'unknown'", "yoe": "0D",
            "is_active_contractor": "false", "created_at": NOW, "updated_at": NOW,
        },
    ),
    "jobs": Table(
        columns(
            id="long", title="string", client_id="long", jd_text="string",
            required_skills="array<string>", location="string", remote_ok="boolean",
            rate_min="double", rate_max="double", visa_requirement="string", min_yoe="double",
            max_yoe="double", status="string",
        )
        .add("embedding", VECTOR)
        .add("created_at", T.TimestampType())
        .add("updated_at", T.TimestampType()),
        required=("title", "client_id"),
        max_length={"title": 256, "location": 128},
        domains={"visa_requirement": VISA_STATUSES, "status": JOB_STATUSES},
        links={"client_id": "clients"},
        defaults={
            "required_skills": "array()", "remote_ok": "false", "min_yoe": "0D",
            "status": "'open'", "created_at": NOW, "updated_at": NOW,
        },
    ),
    "placements": Table(
        columns(
            id="long", candidate_id="long", job_id="long", recruiter_id="long",
            client_id="long", stage="string", match_score="double", skill_gap="string",
            bill_rate="double", pay_rate="double", margin="double", submitted_at="timestamp",
            updated_at="timestamp",
        ),
        required=("candidate_id", "job_id", "client_id"),
        domains={"stage": STAGES},
        links={
            "candidate_id": "candidates", "job_id": "jobs",
            "recruiter_id": "recruiters", "client_id": "clients",
        },
        defaults={"stage": "'submitted'", "submitted_at": NOW, "updated_at": NOW},
    ),
    "timesheets": Table(
        columns(
            id="long", contractor_id="long", week_start="date", hours="double",
            overtime_hours="double", status="string", anomaly_flag="boolean",
            anomaly_score="double", anomaly_reason="string", created_at="timestamp",
        ),
        required=("contractor_id", "week_start", "hours"),
        max_length={"anomaly_reason": 256},
        domains={"status": TIMESHEET_STATUSES},
        links={"contractor_id": "candidates"},
        defaults={
            "overtime_hours": "0D", "status": "'pending'", "anomaly_flag": "false",
            "created_at": NOW,
        },
    ),
    "payroll": Table(
        columns(
            id="long", contractor_id="long", period="date", bill_rate="double",
            pay_rate="double", margin="double", margin_pct="double", created_at="timestamp",
        ),
        required=("contractor_id", "period", "bill_rate", "pay_rate", "margin", "margin_pct"),
        links={"contractor_id": "candidates"},
        defaults={"created_at": NOW},
    ),
    "predictions": Table(
        columns(
            id="long", entity_type="string", entity_id="long", model_name="string",
            score="double", features="string", created_at="timestamp",
        ),
        required=("entity_type", "entity_id", "model_name", "score"),
        max_length={"entity_type": 32, "model_name": 64},
        defaults={"created_at": NOW},
        partition_by=("model_name",),
    ),
}


def check_domain(value: str | None, domain: tuple[str, ...], what: str) -> None:
    """Reject a value outside its domain before any job starts."""
    if value is not None and value not in domain:
        raise ValueError(f"{value!r} is no valid {what}; expected one of {', '.join(domain)}")
