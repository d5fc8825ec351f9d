"""Reports whose tables are given but whose rules are this package's own definitions.

Scores, weights and thresholds below are ours and documented per function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..operators.aggregates import margin_leakage_clients
from ..operators.eligibility import eligible_topk
from ..operators.joins import join_per_key
from ..operators.ranks import nth_value
from ..schemas import STAGES
from ..session import materialise


def skill_gap(required: Column, held: Column) -> Column:
    """JSON with the missing skills and a severity by the missing share (thirds)."""
    missing = F.array_except(required, held)
    n, of = F.size(missing), F.size(required)
    severity = (
        F.when(n == 0, F.lit("none")).when(n * 3 <= of, F.lit("low"))
        .when(n * 3 <= of * 2, F.lit("medium")).otherwise(F.lit("high"))
    )
    return F.to_json(F.struct(missing.alias("missing"), severity.alias("severity")))


def match_scores(placements: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Score 0-100 and skill gap of every placement's candidate-job pair.

    50 points for the share of required skills held, 20 for the visa, 20 for the
    experience range, 10 for the rate. Two key joins; no pair is formed that is not a
    placement.
    """
    c = candidates.select(
        F.col("id").alias("candidate_id"), "skills", "visa_status", "yoe", "rate"
    )
    j = jobs.select(
        F.col("id").alias("job_id"), "required_skills", "visa_requirement", "min_yoe", "max_yoe", "rate_max"
    )
    held, wanted = F.col("skills"), F.col("required_skills")

    def points(n: int, met: Column) -> Column:
        return F.when(met, n).otherwise(0)

    overlap = F.when(F.size(wanted) == 0, 50.0).otherwise(
        F.lit(50.0) * F.size(F.array_intersect(wanted, held)) / F.size(wanted)
    )
    visa = F.col("visa_requirement").isNull() | (F.col("visa_requirement") == F.col("visa_status"))
    yoe = (F.col("yoe") >= F.col("min_yoe")) & (F.col("max_yoe").isNull() | (F.col("yoe") <= F.col("max_yoe")))
    rate = F.col("rate_max").isNull() | (F.col("rate") <= F.col("rate_max"))
    return (
        placements.select("id", "candidate_id", "job_id")
        .join(c, "candidate_id")
        .join(j, "job_id")
        .select(
            "id", "candidate_id", "job_id",
            (overlap + points(20, visa) + points(20, yoe) + points(10, rate)).alias("match_score"),
            skill_gap(wanted, held).alias("skill_gap"),
        )
    )


def best_candidates(jobs: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k eligible candidates nearest to every open job by embedding; see operators.eligibility for the terms."""
    return eligible_topk(jobs.where(F.col("status") == "open"), candidates, k)


def refresh_clients(clients: DataFrame, jobs: DataFrame, placements: DataFrame) -> DataFrame:
    """Clients with req_volume = open jobs and margin_pct = margin over bill of all placements."""
    volume = jobs.where(F.col("status") == "open").groupBy("client_id").agg(F.count("*").alias("_open"))
    margin = placements.groupBy("client_id").agg(
        F.sum(F.col("margin").cast("decimal(18,4)")).alias("_margin"),
        F.sum(money(F.col("bill_rate"))).alias("_bill"),
    )
    pct = F.col("_margin").cast("double") * 100 / F.nullif(F.col("_bill").cast("double"), F.lit(0.0))
    return (
        clients.join(volume, F.col("id") == volume["client_id"], "left").drop("client_id")
        .join(margin, F.col("id") == margin["client_id"], "left").drop("client_id")
        .withColumns({"req_volume": F.coalesce("_open", F.lit(0)).cast("int"), "margin_pct": pct})
        .select(*clients.columns)
    )


def _tall(row: DataFrame) -> DataFrame:
    """One row of counts or sums as (metric, value) rows."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns
    ])
    return row.select(F.inline(pairs))


def landing_kpis(jobs: DataFrame, candidates: DataFrame, placements: DataFrame, as_of: str) -> DataFrame:
    """Open jobs, active contractors, and the month-to-date submissions and hires."""
    day = F.lit(as_of).cast("date")
    this_month = placements.where(
        (F.col("submitted_at") >= F.trunc(day, "MM")) & (F.col("submitted_at") < F.date_add(day, 1))
    )
    parts = [
        jobs.agg(F.count_if(F.col("status") == "open").alias("open_jobs")),
        candidates.agg(F.count_if(F.col("is_active_contractor")).alias("active_contractors")),
        this_month.agg(
            F.count("*").alias("submissions_mtd"), F.count_if(F.col("stage") == "hire").alias("hires_mtd")
        ),
    ]
    return reduce(DataFrame.unionByName, [_tall(p) for p in parts])


def timesheet_findings(timesheets: DataFrame, z_limit: float = 3.0, hour_limit: float = 60.0) -> DataFrame:
    """Sheets whose hours lie z_limit standard deviations above their contractor's mean, or reach hour_limit.

    The sums per contractor are exact decimals and combine on the map side; they join
    back as one row per contractor, those of contractors with many sheets by broadcast.
    """
    h = F.col("hours")
    stats = timesheets.groupBy("contractor_id").agg(
        F.count("*").alias("sheets"),
        F.count("hours").alias("n"),
        F.sum(money(h)).cast("double").alias("s1"),
        F.sum((money(h) * money(h)).cast("decimal(28,4)")).cast("double").alias("s2"),
    ).select(
        "contractor_id",
        "sheets",
        (F.col("s1") / F.col("n")).alias("mean"),
        F.sqrt(F.greatest(F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) * (F.col("s1") / F.col("n")), F.lit(0.0))).alias("sd"),
    )
    z = (h - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return (
        join_per_key(timesheets, stats, "contractor_id", "sheets")
        .withColumn("score", F.round(z, 6))
        .where((h >= hour_limit) | (F.col("score") >= z_limit))
        .select(
            "id", "contractor_id", "hours", "score",
            F.when(h >= hour_limit, F.lit("hours over limit")).otherwise(F.lit("far above own mean")).alias("reason"),
        )
    )


#: Median distances from the median, times this, estimate the standard deviation of normal values.
NORMAL_SPREAD = 1.4826


def robust_findings(timesheets: DataFrame, limit: float = 3.5) -> DataFrame:
    """Sheets whose hours lie `limit` robust deviations or more above their contractor's median: id, contractor_id, hours, median, mad, robust_score.

    The median (of an even number, the lower middle value) and then the median of the distances from it are selected
    exactly, each over counts per value, so a contractor with most of the sheets is no single task. One outlier
    moves neither, unlike mean and deviation. Sheets without hours or contractor take no part; where half of a contractor's
    sheets agree with the median there is no spread, and no finding.
    """
    sheets = timesheets.where("hours is not null and contractor_id is not null").select("id", "contractor_id", "hours")
    counts = materialise(sheets.groupBy("contractor_id").agg(F.count("*").alias("n")), "sheets-per-contractor")

    def middle(rows: DataFrame, value: str, name: str) -> DataFrame:
        found = nth_value(rows, "contractor_id", value, lambda n: F.floor((n + 1) / 2), near=0.5)
        # Stored, so that its size is known when it meets the sheets: a small one is broadcast, and no sheet moves.
        return materialise(counts.join(found.withColumnRenamed("nth_value", name), "contractor_id"), f"{name}-per-contractor")

    placed = join_per_key(sheets, middle(sheets, "hours", "median"), "contractor_id", "n").drop("n")
    placed = materialise(placed.withColumn("away", F.abs(F.col("hours") - F.col("median"))), "sheets-from-median")
    score = (F.col("hours") - F.col("median")) / F.nullif(F.lit(NORMAL_SPREAD) * F.col("mad"), F.lit(0.0))
    return (
        join_per_key(placed, middle(placed, "away", "mad"), "contractor_id", "n")
        .withColumn("robust_score", F.round(score, 6))
        .where(F.col("robust_score") >= limit)
        .select("id", "contractor_id", "hours", "median", "mad", "robust_score")
    )


def attrition_risk(candidates: DataFrame) -> DataFrame:
    """Risk 0-1 of active contractors: 0.2 short tenure (under 180 days), 0.3 silence
    (up to 30 days), 0.2 overtime (up to 25 %), 0.3 low feedback (5 is best). A missing
    input adds nothing.
    """
    def part(weight: float, share: Column) -> Column:
        bounded = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
        return F.coalesce(F.lit(weight) * bounded, F.lit(0.0))

    score = (
        part(0.2, (F.lit(180.0) - F.col("tenure_days")) / 180)
        + part(0.3, F.col("comms_gap_days") / F.lit(30.0))
        + part(0.2, F.col("overtime_pct") / 25)
        + part(0.3, (F.lit(5.0) - F.col("client_feedback_score")) / 5)
    )
    return candidates.where(F.col("is_active_contractor").eqNullSafe(True)).select(
        "id", "name", F.round(score, 6).alias("attrition_risk_score")
    )


def client_churn(placements: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Placements and revenue per client in the last window and the one before, with a risk level.

    high: nothing in the last window; medium: at most half the revenue of the window
    before; low otherwise. Clients without placements in either window are left out.
    """
    end = F.lit(as_of).cast("timestamp")
    at = F.col("submitted_at")
    start, middle = F.timestamp_add("DAY", F.lit(-2 * days), end), F.timestamp_add("DAY", F.lit(-days), end)
    late = at >= middle
    bill = money(F.col("bill_rate"))
    zero = F.lit(0).cast("decimal(28,2)")
    sums = placements.where((at >= start) & (at < end)).groupBy("client_id").agg(
        F.count_if(late).alias("recent"),
        F.count_if(~late).alias("earlier"),
        F.coalesce(F.sum(F.when(late, bill)), zero).alias("recent_revenue"),
        F.coalesce(F.sum(F.when(~late, bill)), zero).alias("earlier_revenue"),
        F.max(at).alias("last_at"),
    )
    risk = (
        F.when(F.col("recent") == 0, F.lit("high"))
        .when(F.col("recent_revenue") * 2 <= F.col("earlier_revenue"), F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return sums.select(
        "client_id", "recent", "earlier",
        F.col("recent_revenue").cast("double").alias("recent_revenue"),
        F.col("earlier_revenue").cast("double").alias("earlier_revenue"),
        F.datediff(end, F.col("last_at")).alias("days_since_last"),
        risk.alias("risk"),
    )


def revenue_forecast(payroll: DataFrame, horizon: int = 6) -> DataFrame:
    """The next months' revenue: a linear trend and the same month a year earlier.

    Works on one row per month. The trend is least squares with exact whole-number sums.
    """
    month = F.trunc("period", "MM").alias("month")
    monthly = payroll.groupBy(month).agg(F.sum(money(F.col("bill_rate"))).alias("revenue"))
    origin = F.lit("1970-01-01").cast("date")
    x = F.months_between("month", origin).cast("decimal(10,0)")
    y = (F.col("revenue") * 100).cast("decimal(24,0)")
    fit = monthly.agg(
        F.count("*").cast("decimal(10,0)").alias("n"),
        F.sum(x).cast("decimal(14,0)").alias("sx"),
        F.sum(y).cast("decimal(28,0)").alias("sy"),
        F.sum(x * x).cast("decimal(18,0)").alias("sxx"),
        F.sum((x * y).cast("decimal(36,0)")).cast("decimal(36,0)").alias("sxy"),
        F.max("month").alias("last"),
    )
    slope = (
        (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
        / F.nullif((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double"), F.lit(0.0))
    )
    ahead = fit.select(
        slope.alias("slope"), "n", "sx", "sy", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "last",
    ).withColumn("month", F.add_months("last", F.col("step")))
    mean_y = F.col("sy").cast("double") / F.col("n").cast("double")
    mean_x = F.col("sx").cast("double") / F.col("n").cast("double")
    at = F.months_between("month", origin)
    trend = F.round((mean_y + F.col("slope") * (at - mean_x)) / 100, 2)
    year_ago = monthly.select(
        F.add_months("month", 12).alias("month"), F.col("revenue").cast("double").alias("seasonal")
    )
    return ahead.select("month", trend.alias("trend")).join(year_ago, "month", "left")


def recruiter_kpis(placements: DataFrame, recruiters: DataFrame) -> DataFrame:
    """Submissions, hires, conversion and margin per recruiter, ranked by hires in the team."""
    work = placements.where(F.col("recruiter_id").isNotNull()).groupBy("recruiter_id").agg(
        F.count("*").alias("submissions"),
        F.count_if(F.col("stage") == "hire").alias("hires"),
        F.sum(F.col("margin").cast("decimal(18,4)")).cast("double").alias("margin"),
    )
    best_first = Window.partitionBy("team").orderBy(F.desc("hires"), F.desc("margin"), "id")
    return (
        recruiters.select("id", "name", "team")
        .join(work, F.col("id") == F.col("recruiter_id"), "left")
        .drop("recruiter_id")
        .fillna(0, ["submissions", "hires"]).fillna(0.0, ["margin"])
        .withColumns({
            "conversion": F.col("hires") / F.nullif(F.col("submissions"), F.lit(0)),
            "team_rank": F.row_number().over(best_first),
        })
    )


def funnel_conversion(placements: DataFrame) -> DataFrame:
    """All stages in order with their counts, zero included, and the ratio to the stage before.

    'rejected' is no step of the funnel and has no ratio. One aggregate row, unfolded.
    """
    counts = placements.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])
    rows = []
    for i, s in enumerate(STAGES):
        ratio = F.lit(None).cast("double")
        if 0 < i < len(STAGES) - 1:
            ratio = F.col(s) / F.nullif(F.col(STAGES[i - 1]), F.lit(0))
        rows.append(F.struct(
            F.lit(i + 1).alias("position"), F.lit(s).alias("stage"),
            F.col(s).alias("count"), ratio.alias("ratio"),
        ))
    return counts.select(F.inline(F.array(*rows)))


def visa_compliance(candidates: DataFrame) -> DataFrame:
    """Candidates and active contractors per visa status."""
    return candidates.groupBy("visa_status").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("is_active_contractor")).alias("active_contractors"),
    )


def hire_rates(placements: DataFrame, jobs: DataFrame) -> DataFrame:
    """Historic hire rate per client and required skill.

    Placements are counted per client and job before the join and the unfolding of skills.
    """
    counts = placements.groupBy("client_id", "job_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("stage") == "hire").alias("h")
    )
    return (
        counts.join(jobs.select(F.col("id").alias("job_id"), "required_skills"), "job_id")
        .select("client_id", F.explode("required_skills").alias("skill"), "n", "h")
        .groupBy("client_id", "skill")
        .agg(F.sum("n").alias("placements"), F.sum("h").alias("hires"))
        .withColumn("hire_rate", F.col("hires") / F.col("placements"))
    )


def executive_summary(
    jobs: DataFrame, candidates: DataFrame, placements: DataFrame, clients: DataFrame,
    payroll: DataFrame, as_of: str,
) -> DataFrame:
    """Landing KPIs, funnel counts, payroll revenue and leaking clients as (metric, value)."""
    funnel = funnel_conversion(placements).select(
        F.concat(F.lit("stage_"), "stage").alias("metric"), F.col("count").cast("double").alias("value")
    )
    revenue = payroll.agg(
        F.sum(money(F.col("bill_rate"))).alias("payroll_revenue"), F.count("*").alias("payroll_rows")
    )
    leaking = margin_leakage_clients(clients).agg(F.count("*").alias("leaking_clients"))
    parts = [landing_kpis(jobs, candidates, placements, as_of), funnel, _tall(revenue), _tall(leaking)]
    return reduce(DataFrame.unionByName, parts)
