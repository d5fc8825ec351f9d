"""Literal inputs and results of the resume rules."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from talentmill.functions import text as rules
from talentmill.functions.vocab import KNOWN_SKILLS, SKILL_ALIASES, skill_terms
from talentmill.operators.parsing import observed, parse_documents

RESUME = """
Mira Okafor Lindqvist
mira+jobs@post.lindqvist.se
030.555.0147
Green card since 2015, before that a citizen elsewhere

Profile: 12 years of work on storage engines, mostly in Go and Rust.

Nordwind Labs, 2021 – Present
- moved the billing jobs to Airflow, Snowflake-free, on GCP
- taught k8s and Helm-less deployments to the team
Harbour & Sons, Feb 2014 – Nov 2020
- wrote Kotlin services over MySQL, later Postgres
- tuned Elasticsearch and NumPy code

Tools: Bash, Vue.js, PyTorch, Power BI
"""

CONTACTS = [
    ("write to rosa_9@mail.museum, please", "rosa_9@mail.museum", None),
    ("OFFICE@KIOSK.NET", "office@kiosk.net", None),
    ("<li>tom%tag+x@sub.dept.org</li>", "tom%tag+x@sub.dept.org", None),
    ("ends with q.r@st.uv.", "q.r@st.uv", None),
    ("user at host", None, None),
    ("desk (212) 406-7788 ext 4", None, "(212) 406-7788"),
    ("fax 646.301.2299", None, "646.301.2299"),
    ("ring\n\t718-220-3344", None, "718-220-3344"),
    ("+1 (917) 482-5561", None, "+1 (917) 482-5561"),
    ("cell 305 771 9024", None, "305 771 9024"),
    ("ticket 98765432109", None, "9876543210"),
    ("+1-617-2233", None, None),
]
SKILLS = [
    ("Wrote Scala and Terraform for GCP", ["GCP", "Scala", "Terraform"]),
    ("RUST, then KOTLIN", ["Kotlin", "Rust"]),
    ("Django 4, Next.js, XGBoost", ["Django", "JavaScript", "Next.Js", "Xgboost"]),
    ("vue.js pages", ["JavaScript", "Vue.Js"]),
    ("F# or .NET", []),
    ("old ASP.NET site", [".NET"]),
    ("go-cart, CV attached, ml", ["Computer Vision", "Go", "Machine Learning"]),
    ("érust rustß rust_y", []),
    ("learning  machine, deep  water", []),
    ("elastic search with natural language processing", ["Elasticsearch", "NLP"]),
    ("a calm gardener who likes long walks", []),
    ("", []),
]
YEARS = [
    ("Feb 2016 - Jul 2019\nAug 2019 - Present", 10.0),
    ("2022 - Present, night shift", 4.0),
    ("2017 - NOW", 9.0),
    ("2011 — 2016 forester", 5.0),
    ("2012-2015", 3.0),
    ("2010 - 2015, 2013 - 2019", 5.0),
    ("2018 - 2018, 2012 - 2019", 0.0),
    ("1968 - 1979", 0.0),
    ("2021 - 2033", 0.0),
    ("2019 - 2014, 6 years experience", 6.0),
    ("15+ years of experience with boats", 15.0),
    ("nothing about time", 0.0),
    ("\n".join(f"Post {i}: Apr {1995 + 2 * i} - Mar {1996 + 2 * i}" for i in range(9)), 9.0),
    (RESUME, 11.0),
]
VISAS = [
    ("proud US citizen", "citizen"), ("usc since birth", "citizen"),
    ("needs an H1B transfer", "h1b"), ("on H-1B", "h1b"), ("OPT until May", "opt"),
    ("stem opt, second year", "stem_opt"), ("holds a green card", "gc"), ("permanent resident", "gc"),
    ("employment authorization document", "ead"), ("likes tea", "unknown"),
    ("I tread lightly, OPT", "ead"), ("spread sheets", "ead"), ("adopted a cat", "opt"),
    ("optics", "opt"), ("muscle memory", "citizen"), (RESUME, "gc"),
]
NAMES = [
    ("Ada Byron\nx", "Ada Byron"), ("\n  Zoë  Brontë \r\n", "Zoë  Brontë"), ("Brontë, Zoë", None),
    ("Ada", None), ("a b c d e", None), ("1\n2\n3\n4\n5\nAda Byron", None), ("1\n2\n3\n4\nAda Byron", "Ada Byron"),
]
TRUNCATED = [
    ("a" * 10, 20, "a" * 10), ("a" * 17 + ".bbbb", 20, "a" * 17 + "."), ("a." + "b" * 30, 20, "a." + "b" * 18),
    ("a" * 16 + ".bbbb", 20, "a" * 16 + ".bbb"), ("x" * 25, 20, "x" * 20), ("é😀" * 20, 20, "é😀" * 10),
]


def apply(spark, inputs, *columns):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, text string")
    rows = rows.withColumn("lowered", F.lower("text"))
    rows = rows.withColumn("hits", rules.vocabulary_hits(F.col("lowered")))
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_contacts(spark):
    text = F.col("text")
    got = apply(spark, [c[0] for c in CONTACTS], rules.extract_email(text), rules.extract_phone(text))
    assert got == [c[1:] for c in CONTACTS]


@pytest.mark.parametrize(
    "cases, column",
    [
        (SKILLS, rules.extract_skills), (YEARS, rules.extract_yoe), (VISAS, rules.extract_visa),
        (NAMES, rules.extract_name),
    ],
    ids=["skills", "years", "visa", "name"],
)
def test_rule(spark, cases, column):
    args = {
        rules.extract_skills: (F.col("lowered"), F.col("hits")), rules.extract_yoe: (F.col("text"), 2026),
        rules.extract_visa: (F.col("lowered"),), rules.extract_name: (F.col("text"),),
    }[column]
    assert [r[0] for r in apply(spark, [c[0] for c in cases], column(*args))] == [c[1] for c in cases]


def test_every_term_is_found_alone(spark):
    """Terms that start and end with a word character yield their label."""
    terms = {t: label for t, label in skill_terms().items() if t[0].isalnum() and t[-1].isalnum()}
    got = apply(spark, [f"x ({t}) y" for t in terms], rules.extract_skills(F.col("lowered"), F.col("hits")))
    for (found,), (term, label) in zip(got, terms.items()):
        assert label in found, term


def test_vocabulary_sizes():
    assert (len(SKILL_ALIASES), len(set(SKILL_ALIASES.values())), len(KNOWN_SKILLS)) == (86, 48, 66)
    assert len(skill_terms()) == 118


def test_normalise(spark):
    cases = {
        "reactjs": "React", " NodeJS ": "Node.js", "k8s": "Kubernetes", "ml": "Machine Learning",
        "scikit-learn": "Scikit-Learn", "vue.js": "Vue.Js", "o'neil's tool": "O'Neil'S Tool", "élan vital": "Élan Vital",
    }
    assert [r[0] for r in apply(spark, list(cases), rules.normalise_skill(F.col("text")))] == list(cases.values())


def test_truncate(spark):
    got = apply(spark, [c[0] for c in TRUNCATED], rules.truncate_at_sentence(F.col("text"), 20))
    assert [r[0] for r in got] == [c[2] for c in TRUNCATED]


def test_embed_texts_leave_out_empty_parts(spark):
    row = spark.sql("select 'cv' r, array('Python', 'Go') s, '' l, 'citizen' v, 0D y, cast(null as string) n")
    c = rules.candidate_embed_text(F.col("r"), F.col("s"), F.col("l"), F.col("v"), F.col("y"))
    j = rules.job_embed_text(F.col("r"), F.col("n"), F.array().cast("array<string>"), F.col("v"), F.lit(2.5))
    assert tuple(row.select(c, j).first()) == (
        "cv\nSkills: Python, Go\nVisa: citizen",
        "Job title: cv\nLocation: citizen\nMinimum experience: 2.5 years",
    )


def test_blank_documents_are_rejected(spark):
    rows = spark.createDataFrame([(1, RESUME), (2, " \n\t "), (3, None), (4, "x")], "id int, text string")
    got = {r["id"]: r for r in parse_documents(rows, 2026).collect()}
    assert got[1]["name"] == "Mira Okafor Lindqvist" and got[1]["status"] == "parsed"
    assert got[4]["name"] == "Unknown" and got[4]["skills"] == []
    for i in (2, 3):
        assert (got[i]["status"], got[i]["error"], got[i]["name"], got[i]["skills"]) == ("rejected", "no text", None, None)


def test_outcomes_are_observed_with_the_job(spark):
    rows = spark.createDataFrame([(1, "Ada Byron"), (2, " "), (3, "x")], "id int, text string")
    metrics = Observation("outcomes")
    observed(parse_documents(rows, 2026), metrics).write.format("noop").mode("overwrite").save()
    assert metrics.get == {"rows": 3, "parsed": 2, "failed": 1}


def test_parsing_needs_no_shuffle(spark):
    rows = spark.range(10).select("id", F.lit("Ada Byron").alias("text"))
    plan = parse_documents(rows, 2026)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan
