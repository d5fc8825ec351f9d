"""Best candidates per job among those who meet its terms: an interval join, then cosines in bounded blocks.

A candidate is eligible for a job if
- the job requires no visa status, or the candidate's;
- the candidate's years of experience (unknown: 0) lie within the job's bounds, where it has them;
- the job has no greatest rate, or the candidate's rate does not exceed it (an unknown rate does not meet a limit);
- the job requires no skills, or the candidate has one of them.

Visa status and shared skill are equi keys. Experience and rate are cut into a bounded number of
bands: a candidate lies in one band of each, a job's range is spread over the bands that it touches, and the exact
bounds are tested where both meet. Only then are cosines taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..session import materialise, ship_package
from .joins import join_per_key
from .similarity import best_columns, unit_rows

#: Years in a band of experience, and bands; the last one is open.
YEARS, YEAR_BANDS = 5.0, 8
#: Rates are cut at these quantiles of the candidates' rates.
RATE_CUTS = (0.25, 0.5, 0.75)
BLOCK_ROWS = 2048


def _year_band(years: Column) -> Column:
    """Null for null: least and greatest would skip it."""
    return F.when(years.isNotNull(), F.least(F.greatest(F.floor(years / YEARS), F.lit(0)), F.lit(YEAR_BANDS - 1)).cast("int"))


def _rate_band(rate: Column, cuts: list[float]) -> Column:
    return sum((F.when(rate > c, 1).otherwise(0) for c in cuts), F.lit(0))


def _cell(visa: Column) -> Column:
    return F.concat_ws("\x01", "skill", visa, "years", "band").alias("cell")


def _spread(jobs: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and candidates with one row per cell in which they may meet."""
    rates = candidates.agg(F.percentile_approx("rate", list(RATE_CUTS))).first()[0] or []
    cuts = sorted(set(rates))
    unknown = len(cuts) + 1
    years = F.coalesce("yoe", F.lit(0.0))
    people = candidates.withColumns({
        "yoe": years, "years": _year_band(years),
        "band": F.when(F.col("rate").isNull(), unknown).otherwise(_rate_band(F.col("rate"), cuts)),
        "skills": F.coalesce("skills", F.array().cast("array<string>")),
    })
    people = people.withColumn("skill", F.explode(F.array_distinct(F.concat(F.array_compact("skills"), F.array(F.lit("")))))).withColumn(
        "visa", F.explode(F.array_compact(F.array(F.lit("any"), F.concat(F.lit("is "), F.col("visa_status"))))))

    lowest = F.coalesce(_year_band(F.col("min_yoe")), F.lit(0))
    highest = F.coalesce(_year_band(F.col("max_yoe")), F.lit(YEAR_BANDS - 1))
    asked = jobs.where("min_yoe is null or max_yoe is null or min_yoe <= max_yoe").withColumns({
        "wanted": F.array_distinct(F.array_compact(F.coalesce("required_skills", F.array().cast("array<string>")))),
        "visa": F.coalesce(F.concat(F.lit("is "), F.col("visa_requirement")), F.lit("any")),
        "years": F.explode(F.sequence(lowest, highest)),
    }).withColumn("band", F.explode(F.sequence(F.lit(0), F.when(
        F.col("rate_max").isNull(), unknown).otherwise(_rate_band(F.col("rate_max"), cuts)))))
    # A pair that shares several skills meets in as many cells, and counts in that of the first one the job lists.
    asked = asked.withColumn("wanted", F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(F.array(F.lit("")))).select(
        "*", F.posexplode("wanted").alias("nth", "skill")).withColumn("before", F.slice("wanted", F.lit(1), F.col("nth")))
    return (
        asked.select("id", "embedding", "min_yoe", "max_yoe", "rate_max", "before", _cell(F.col("visa"))),
        people.select("id", "embedding", "yoe", "rate", "skills", _cell(F.col("visa"))),
    )


def meeting_cells(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Columns cell, n_jobs, n_candidates: the cells with rows of both sides; their product is what may be scored."""
    asked, people = _spread(jobs, candidates)
    return asked.groupBy("cell").agg(F.count("*").alias("n_jobs")).join(
        people.groupBy("cell").agg(F.count("*").alias("n_candidates")), "cell")


def _shared(before: pd.Series, skills: pd.Series) -> np.ndarray:
    """Mask (jobs x candidates) of pairs that already met under an earlier skill of the job."""
    names = {s: i for i, s in enumerate(sorted({s for row in before for s in row}))}
    if not names:
        return np.zeros((len(before), len(skills)), bool)

    def member(rows: pd.Series) -> np.ndarray:
        m = np.zeros((len(rows), len(names)), np.float32)
        for i, row in enumerate(rows):
            m[i, [names[s] for s in row if s in names]] = 1
        return m

    return member(before) @ member(skills).T > 0


def _scan(k: int):
    def scan(jobs: pd.DataFrame, people: pd.DataFrame) -> pd.DataFrame:
        if not len(jobs) or not len(people):
            return pd.DataFrame({"job_id": [], "candidate_id": [], "similarity": []})
        people = people.sort_values("id", kind="stable")
        yoe, rate = (people[c].to_numpy(float)[None, :] for c in ("yoe", "rate"))
        least, most, limit = (jobs[c].to_numpy(float)[:, None] for c in ("min_yoe", "max_yoe", "rate_max"))
        fits = (np.isnan(least) | (yoe >= least)) & (np.isnan(most) | (yoe <= most)) & (np.isnan(limit) | (rate <= limit))
        fits &= ~_shared(jobs["before"], people["skills"])
        s = np.where(fits, np.round(unit_rows(jobs["embedding"]) @ unit_rows(people["embedding"]).T, 6), -np.inf)
        order = best_columns(s, k)
        out = pd.DataFrame({
            "job_id": np.repeat(jobs["id"].to_numpy(), order.shape[1]),
            "candidate_id": people["id"].to_numpy()[order].ravel(),
            "similarity": np.take_along_axis(s, order, axis=1).ravel(),
        })
        return out[out["similarity"] > -np.inf]

    return scan


def eligible_topk(jobs: DataFrame, candidates: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Columns job_id, rank, candidate_id, similarity: the k nearest eligible candidates of every job.

    jobs has id, embedding, required_skills, visa_requirement, min_yoe, max_yoe, rate_max; candidates has id,
    embedding, skills, visa_status, yoe, rate. Ties go to the smaller candidate id; vectors without a direction take no
    part. A cell's rows are cut into blocks of about block_rows on both sides, so a skill that
    a third of all people have is many bounded tasks. Every pair is scored in one cell at most.
    """
    ship_package(jobs.sparkSession)

    def directed(df: DataFrame) -> DataFrame:
        return df.where(norm(F.col("embedding")) > 0).withColumn("id", F.col("id").cast("long"))

    jobs = materialise(directed(jobs.select(
        "id", "embedding", "required_skills", "visa_requirement", "min_yoe", "max_yoe", "rate_max")), "eligible-jobs")
    candidates = materialise(directed(candidates.select("id", "embedding", "skills", "visa_status", "yoe", "rate")), "eligible-people")
    cells = materialise(meeting_cells(jobs, candidates), "eligible-cells")
    asked, people = _spread(jobs, candidates)

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / block_rows)

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), blocks(n))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))

    asked = join_per_key(asked, cells, "cell", "n_jobs").withColumn("qb", own("n_jobs")).withColumn("cb", every("n_candidates"))
    people = join_per_key(people, cells, "cell", "n_candidates").withColumn("cb", own("n_candidates")).withColumn("qb", every("n_jobs"))
    keys = ("cell", "qb", "cb")
    hits = asked.drop("n_jobs", "n_candidates").groupBy(*keys).cogroup(people.drop("n_jobs", "n_candidates").groupBy(*keys)).applyInPandas(
        _scan(k), "job_id long, candidate_id long, similarity double")
    ranked = Window.partitionBy("job_id").orderBy(F.desc("similarity"), "candidate_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "job_id", "rank", "candidate_id", "similarity")
