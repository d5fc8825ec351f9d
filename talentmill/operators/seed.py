"""Demo data at any size: rows derived from ids by hashing, so they never depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STAGES
from .derived import margin_columns, overtime, pay_period, week_start

# Shares of the drawn statuses.
VISA_SHARES = {"citizen": 0.40, "gc": 0.20, "h1b": 0.25, "opt": 0.08, "stem_opt": 0.04, "ead": 0.03}
STAGE_SHARES = {"submitted": 0.35, "interview": 0.25, "offer": 0.10, "hire": 0.15, "rejected": 0.15}
JOB_STATUS_SHARES = {"open": 0.6, "on_hold": 0.15, "filled": 0.15, "closed": 0.10}
CONTRACTOR_SHARE = 0.4
ANOMALY_SHARE = 0.05
WEEKS = 12
PAY_PERIODS = 3

SKILLS = (
    "Python", "Java", "JavaScript", "React", "AWS", "Docker", "Kubernetes", "PostgreSQL",
    "Machine Learning", "Terraform", "Spark", "Kafka", "Go", "TypeScript",
)
CITIES = ("Austin", "Boston", "Chicago", "Denver", "Remote", "Seattle")
INDUSTRIES = ("Finance", "Health", "Retail", "Energy", "Media")


def draw(key: Column, purpose: str) -> Column:
    """A number in [0, 1) fixed by the key and the purpose."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(":" + purpose)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def whole(key: Column, purpose: str, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(draw(key, purpose) * (high - low + 1)) + low).cast("int")


def tenths(key: Column, purpose: str, low: float, high: float) -> Column:
    """A number from low to high in steps of 0.1."""
    return whole(key, purpose, round(low * 10), round(high * 10)) / F.lit(10.0)


def by_share(key: Column, purpose: str, shares: dict[str, float]) -> Column:
    u, upto, out = draw(key, purpose), 0, F
    *firsts, last = shares
    for name in firsts:
        upto += round(shares[name] * 100)
        out = out.when(u < upto / 100, F.lit(name))
    return out.otherwise(F.lit(last))


def one_of(key: Column, purpose: str, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), whole(key, purpose, 0, len(values) - 1))


def some_skills(key: Column, purpose: str, low: int, high: int) -> Column:
    """Between low and high skills, in the order of a hash per skill."""
    order = F.array_sort(F.array(*[
        F.struct(F.md5(F.concat(key.cast("string"), F.lit(f":{purpose}:{s}"))).alias("h"), F.lit(s).alias("s"))
        for s in SKILLS
    ]))
    return F.transform(F.slice(order, F.lit(1), whole(key, purpose, low, high)), lambda x: x["s"])


def seed_clients(ids: DataFrame) -> DataFrame:
    k = F.col("id")
    return ids.select(
        "id",
        F.concat(F.lit("Client "), k.cast("string")).alias("name"),
        one_of(k, "industry", INDUSTRIES).alias("industry"),
        F.concat(F.lit("Contact Person "), k.cast("string")).alias("contact_name"),
        F.concat(F.lit("contact"), k.cast("string"), F.lit("@example.com")).alias("contact_email"),
        F.lit("active").alias("status"),
        whole(k, "req_volume", 1, 8).alias("req_volume"),
        tenths(k, "margin_pct", 8, 30).alias("margin_pct"),
    )


def seed_recruiters(ids: DataFrame) -> DataFrame:
    k = F.col("id")
    return ids.select(
        "id",
        F.concat(F.lit("Recruiter "), k.cast("string")).alias("name"),
        F.concat(F.lit("recruiter"), k.cast("string"), F.lit("@example.com")).alias("email"),
        one_of(k, "team", ("East", "West", "Central")).alias("team"),
    )


def seed_candidates(ids: DataFrame) -> DataFrame:
    k = F.col("id")
    contractor = draw(k, "contractor") < CONTRACTOR_SHARE
    return ids.select(
        "id",
        F.concat(F.lit("Candidate "), k.cast("string")).alias("name"),
        F.concat(F.lit("candidate"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1-555-"), whole(k, "phone", 1000, 9999).cast("string")).alias("phone"),
        some_skills(k, "skills", 3, 7).alias("skills"),
        by_share(k, "visa", VISA_SHARES).alias("visa_status"),
        one_of(k, "location", CITIES).alias("location"),
        tenths(k, "yoe", 1, 15).alias("yoe"),
        whole(k, "rate", 50, 140).cast("double").alias("rate"),
        contractor.alias("is_active_contractor"),
        F.when(contractor, whole(k, "tenure", 30, 720)).alias("tenure_days"),
        F.when(contractor, whole(k, "gap", 0, 30)).alias("comms_gap_days"),
        F.when(contractor, tenths(k, "overtime", 0, 25)).alias("overtime_pct"),
        F.when(contractor, tenths(k, "feedback", 2.5, 5)).alias("client_feedback_score"),
    )


def seed_jobs(ids: DataFrame, n_clients: int | Column) -> DataFrame:
    """Jobs spread over clients with ids below n_clients."""
    k = F.col("id")
    low = whole(k, "rate_min", 50, 90).cast("double")
    skills = some_skills(k, "required", 3, 6)
    title = F.concat(one_of(k, "title", ("Data", "Cloud", "Backend", "Security", "Platform")), F.lit(" Engineer"))
    city = one_of(k, "location", CITIES)
    return ids.select(
        "id",
        title.alias("title"),
        F.pmod(F.floor(draw(k, "client") * 4294967296).cast("long"), F.lit(n_clients) if isinstance(n_clients, int) else n_clients).alias("client_id"),
        F.concat(F.lit("We need a "), title, F.lit(" with "), F.array_join(F.slice(skills, 1, 3), ", "), F.lit(" in "), city, F.lit(".")).alias("jd_text"),
        skills.alias("required_skills"),
        city.alias("location"),
        (draw(k, "remote") < 0.3).alias("remote_ok"),
        low.alias("rate_min"),
        (low + whole(k, "rate_span", 15, 40)).alias("rate_max"),
        F.when(draw(k, "visa_requirement") >= 0.7, F.lit("citizen")).alias("visa_requirement"),
        tenths(k, "min_yoe", 1, 5).alias("min_yoe"),
        tenths(k, "max_yoe", 6, 15).alias("max_yoe"),
        by_share(k, "status", JOB_STATUS_SHARES).alias("status"),
    )


def seed_placements(
    ids: DataFrame, n_candidates: int | Column, n_jobs: int | Column, n_recruiters: int | Column, jobs: DataFrame, as_of: str,
) -> DataFrame:
    """Placements of drawn candidates in drawn jobs, at the job's client and inside its rate band.

    The counts may be scalar subqueries over the tables that are linked to.
    """
    k = F.col("id")

    def link(purpose: str, n: int | Column) -> Column:
        return F.floor(draw(k, purpose) * n).cast("long")

    drawn = ids.select(
        "id", link("candidate", n_candidates).alias("candidate_id"),
        link("job", n_jobs).alias("job_id"), link("recruiter", n_recruiters).alias("recruiter_id"),
    )
    band = jobs.select(F.col("id").alias("job_id"), "client_id", "rate_min", "rate_max")
    bill = F.round((F.col("rate_min") + draw(k, "bill") * (F.col("rate_max") - F.col("rate_min"))).cast("decimal(18,6)"), 2)
    pay = F.round(bill * (draw(k, "pay") * 0.2 + 0.65).cast("decimal(10,6)"), 2)
    missing = F.slice(some_skills(k, "missing", 1, 3), F.lit(1), whole(k, "n_missing", 0, 3))
    share = F.size(missing)
    severity = F.when(share == 0, "none").when(share == 1, "low").when(share == 2, "medium").otherwise("high")
    return drawn.join(band, "job_id").select(
        "id", "candidate_id", "job_id", "recruiter_id", "client_id",
        by_share(k, "stage", {s: STAGE_SHARES[s] for s in STAGES}).alias("stage"),
        tenths(k, "match", 40, 98).alias("match_score"),
        F.to_json(F.struct(missing.alias("missing"), severity.alias("severity"))).alias("skill_gap"),
        bill.cast("double").alias("bill_rate"),
        pay.cast("double").alias("pay_rate"),
        (bill - pay).cast("double").alias("margin"),
        F.timestamp_add("DAY", -whole(k, "age", 0, 180), F.lit(as_of).cast("timestamp")).alias("submitted_at"),
    )


def seed_timesheets(contractors: DataFrame, as_of: str, weeks: int = WEEKS) -> DataFrame:
    """One sheet per contractor and week back from as_of; a few have far too many hours."""
    per_week = contractors.select(
        F.col("id").alias("contractor_id"),
        F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("back"),
    )
    k = F.concat_ws("-", F.col("contractor_id").cast("string"), F.col("back").cast("string"))
    anomaly = draw(k, "anomaly") < ANOMALY_SHARE
    hours = F.when(anomaly, tenths(k, "long_hours", 60, 80)).otherwise(tenths(k, "hours", 35, 45))
    rows = per_week.withColumn("hours", hours)
    monday = week_start(F.date_sub(F.lit(as_of).cast("date"), F.col("back") * 7))
    return rows.select(
        "contractor_id",
        monday.alias("week_start"),
        "hours",
        overtime(F.col("hours")).alias("overtime_hours"),
        F.when(anomaly, "flagged").otherwise("approved").alias("status"),
        anomaly.alias("anomaly_flag"),
        F.when(anomaly, whole(k, "score", 70, 95) / F.lit(100.0)).alias("anomaly_score"),
        F.when(anomaly, "Unusually high weekly hours").alias("anomaly_reason"),
    )


def seed_payroll(contractors: DataFrame, as_of: str, periods: int = PAY_PERIODS) -> DataFrame:
    """One payroll row per contractor (id, rate) and calendar month back from as_of."""
    k = F.col("contractor_id")
    per_month = contractors.select(
        F.col("id").alias("contractor_id"), F.col("rate").alias("pay_rate"),
        F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("back"),
    )
    factor = whole(k, "bill_factor", 125, 160).cast("decimal(10,0)")
    bill = F.round(F.col("pay_rate").cast("decimal(18,2)") * factor / 100, 2).cast("double")
    rows = per_month.withColumn("bill_rate", bill)
    return rows.select(
        "contractor_id",
        pay_period(F.add_months(F.lit(as_of).cast("date"), -F.col("back"))).alias("period"),
        "bill_rate",
        "pay_rate",
        *margin_columns(F.col("bill_rate"), F.col("pay_rate")),
    )
