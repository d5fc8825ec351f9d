"""Best eligible candidates against a plain double loop."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentmill.operators.eligibility import eligible_topk, meeting_cells
from talentmill.operators.similarity import best_columns

JOBS = ("id long, embedding array<float>, required_skills array<string>, visa_requirement string, "
        "min_yoe double, max_yoe double, rate_max double")
PEOPLE = "id long, embedding array<float>, skills array<string>, visa_status string, yoe double, rate double"
SKILLS = [f"s{i}" for i in range(12)]


def some(rng, values, none=0.15):
    return None if rng.random() < none else rng.choice(values)


def tables(n_jobs, n_people, seed=1):
    rng = random.Random(seed)
    vector = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]
    jobs = [(i, vector(), some(rng, [rng.sample(SKILLS, 3), [], [None, "s1", "s1"]]), some(rng, ["citizen", "gc", "any"], 0.5),
             some(rng, [0.0, 3.0, 7.5, 41.0]), some(rng, [2.0, 8.0, 12.0, 60.0]), some(rng, [20.0, 50.0, 80.0])) for i in range(n_jobs)]
    people = [(i, vector(), some(rng, [rng.sample(SKILLS, 4), ["s1", None, "s2"], []]), some(rng, ["citizen", "gc", "h1b"]),
               some(rng, [0.0, 1.0, 3.0, 7.5, 9.0, 45.0]), some(rng, [-5.0, 20.0, 35.0, 50.0, 79.0, 90.0])) for i in range(n_people)]
    return jobs, people


def eligible(j, c):
    wanted, yoe = {s for s in j[2] or [] if s is not None}, c[4] or 0.0
    return ((j[3] is None or j[3] == c[3]) and (j[4] is None or yoe >= j[4]) and (j[5] is None or yoe <= j[5])
            and (j[6] is None or (c[5] is not None and c[5] <= j[6])) and (not wanted or bool(wanted & set(c[2] or []))))


def plain(jobs, people, k):
    out = set()
    for j in jobs:
        if any(j[1]):
            hits = sorted((-round(float(np.dot(j[1], c[1]) / np.linalg.norm(j[1]) / np.linalg.norm(c[1])), 6), c[0])
                          for c in people if any(c[1]) and eligible(j, c))
            out |= {(j[0], r, c, -s) for r, (s, c) in enumerate(hits[:k], 1)}
    return out


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_eligible_topk_equals_double_loop(spark, block_rows):
    jobs, people = tables(40, 90)
    got = eligible_topk(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(people, PEOPLE), 4, block_rows).collect()
    want = plain(jobs, people, 4)
    assert {(r.job_id, r.rank, r.candidate_id) for r in got} == {x[:3] for x in want}
    assert len(got) == len(want) and max(abs(r.similarity - x[3]) for r, x in zip(sorted(got), sorted(want))) < 2e-6


def test_only_pairs_of_meeting_cells_are_scored(spark):
    """Cells hold every eligible pair, and far fewer than all pairs."""
    rng = random.Random(3)
    skills = [f"skill{i}" for i in range(60)]
    jobs = [(i, [1.0], rng.sample(skills, 3), rng.choice([None, "citizen"]), float(i % 12), float(i % 12 + 3), 60.0) for i in range(300)]
    people = [(i, [1.0], rng.sample(skills, 4), rng.choice(["citizen", "gc"]), float(i % 20), 20.0 + i % 90) for i in range(900)]
    cells = meeting_cells(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(people, PEOPLE))
    scored = cells.agg(F.sum(F.col("n_jobs") * F.col("n_candidates"))).first()[0]
    fit = sum(eligible(j, c) for j in jobs for c in people)
    print(f"scored {scored} of {len(jobs) * len(people)} pairs for {fit} eligible ones")
    assert fit <= scored <= 0.1 * len(jobs) * len(people)


def test_empty_sides(spark):
    jobs, people = tables(5, 5)
    none = spark.createDataFrame([], JOBS), spark.createDataFrame([], PEOPLE)
    assert eligible_topk(none[0], spark.createDataFrame(people, PEOPLE), 3).collect() == []
    assert eligible_topk(spark.createDataFrame(jobs, JOBS), none[1], 3).collect() == []


def test_best_columns_take_ties_by_position():
    s = np.array([[1, 3, 3, 2, 3, 0], [5, 5, 5, 5, 5, 5], [-np.inf, 1, -np.inf, 0, -np.inf, -np.inf]])
    for k in (1, 2, 3, 4, 6, 9):
        assert best_columns(s, k).tolist() == np.argsort(-s, axis=1, kind="stable")[:, :k].tolist()
