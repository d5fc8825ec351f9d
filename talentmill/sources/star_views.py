"""Domain tables as views over the supplied star-schema test tables.

Every view is a projection, filter or key join of whole tables, so jobs on it grow
with the data. plans/oracles.py states the same views in SQL.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored_once

SKILL_POOL = (
    "Python", "AWS", "Docker", "Sql", "React", "Kubernetes", "Java", "Spark", "Go", "Terraform",
)
VISA_CYCLE = ("citizen", "gc", "h1b", "opt", "stem_opt", "ead", "other", "unknown")
JOB_STATUS_CYCLE = ("open", "on_hold", "filled", "closed")
ENTITY_CYCLE = ("candidate", "client", "placement")
KIND_OF_EVENT = {
    "signup": "resume_parsed", "view": "embedding_generated", "purchase": "prediction_made",
    "click": "db_query", "error": "db_query",
}


# Schemas of the supplied tables, so that no footer is read while a plan is built.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a test table out by its key: the supplied files are one split each, so one task."""
    return df.repartition(key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")


def _pick(key: Column, values: Sequence[str | None]) -> Column:
    """Value by key modulo the number of values."""
    options = F.from_json(F.lit(json.dumps(values)), "array<string>")
    return F.get(options, F.pmod(key, F.lit(len(values))).cast("int"))


def _days_after_2024(key: Column) -> Column:
    return F.timestamp_add("DAY", F.pmod(key, F.lit(365)).cast("int"), F.lit("2024-01-01").cast("timestamp"))


def _cents(col: str) -> Column:
    return F.col(col).cast("decimal(18,2)")


def _pay() -> Column:
    return _cents("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))


def _written(view: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A view that groups the whole fact table is written once per source folder, as a table of a warehouse would be."""
    @wraps(view)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored_once(spark, f"{view.__name__} of {sf_dir.rstrip('/')}", lambda: view(spark, sf_dir))

    return read


def _lines(spark: SparkSession, sf_dir: str, *keys: str, largest: Sequence[str]) -> DataFrame:
    """Order lines summed per key: exact sums over all lines, and columns of the largest line as `l` (ties by larger ids).

    The largest line is the greatest by `l_extendedprice` and then by the columns of `largest`, in this order. Nearly every line has a
    key of its own, so nothing is combined before the lines move: sorting whole splits there would only spill. They are dealt by key once.
    """
    used = (*keys, "l_extendedprice", "l_discount", "l_quantity", "l_shipdate", *largest)
    return table(spark, sf_dir, "lineitem").select(*used).repartition(*keys).groupBy(*keys).agg(
        F.sum(_cents("l_extendedprice")).alias("bill"), F.sum(_pay()).alias("pay"),
        F.sum("l_quantity").alias("hours"), F.max("l_shipdate").alias("shipped"),
        F.max(F.struct("l_extendedprice", *largest)).alias("l"),
    )


def _rates() -> list[Column]:
    """bill_rate, pay_rate and margin of summed lines, exact before the final cast."""
    return [
        F.col("bill").cast("double").alias("bill_rate"),
        F.col("pay").cast("double").alias("pay_rate"),
        (F.col("bill") - F.col("pay")).cast("double").alias("margin"),
    ]


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("industry"),
        F.concat(F.lit("Contact "), key.cast("string")).alias("contact_name"),
        F.concat(F.lit("contact"), key.cast("string"), F.lit("@example.com")).alias("contact_email"),
        F.when(F.col("c_acctbal") < 0, F.lit("churned"))
        .when(key % 10 == 0, F.lit("inactive"))
        .otherwise(F.lit("active")).alias("status"),
        F.col("c_nationkey").alias("req_volume"),
        (F.col("c_acctbal") / 100).alias("margin_pct"),
        _days_after_2024(key).alias("created_at"),
    )


def recruiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey").cast("long")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        key.alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"),
        F.col("r_name").alias("team"),
        _days_after_2024(key).alias("created_at"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    contractor = F.when(key % 5 == 2, F.lit(None)).otherwise(key % 5 < 2)
    is_on = F.coalesce(contractor, F.lit(False))
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("s"), key.cast("string"), F.lit("@example.com")).alias("email"),
        F.array_distinct(
            F.array(_pick(key, SKILL_POOL), _pick(key * 3 + 1, SKILL_POOL), _pick(key * 7 + 2, SKILL_POOL),
                    _pick(F.floor(key / 10), SKILL_POOL))
        ).alias("skills"),
        _pick(key, VISA_CYCLE).alias("visa_status"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("location"),
        F.pmod(key, F.lit(16)).cast("double").alias("yoe"),
        F.col("s_acctbal").alias("rate"),
        F.concat(F.lit("resumes/"), key.cast("string"), F.lit(".pdf")).alias("resume_path"),
        contractor.alias("is_active_contractor"),
        F.when(is_on, (key * 37 % 720).cast("int")).alias("tenure_days"),
        F.when(is_on, (key * 11 % 31).cast("int")).alias("comms_gap_days"),
        F.when(is_on, (key * 7 % 26).cast("double")).alias("overtime_pct"),
        F.when(is_on, (key % 6).cast("double")).alias("client_feedback_score"),
        F.lit(None).cast("double").alias("attrition_risk_score"),
        _days_after_2024(key).alias("created_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    n_clients = table(spark, sf_dir, "customer").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("title"),
        (key % n_clients).alias("client_id"),
        F.concat(F.lit("We need a "), F.col("p_name"), F.lit(" for "), F.col("p_type"), F.lit(" work.")).alias("jd_text"),
        F.array_distinct(
            F.array(_pick(key, SKILL_POOL), _pick(key * 3 + 2, SKILL_POOL), _pick(F.floor(key / 7), SKILL_POOL))
        ).alias("required_skills"),
        F.concat(F.lit("NATION_"), (key % 25).cast("string")).alias("location"),
        (F.col("p_size") % 3 == 0).alias("remote_ok"),
        F.col("p_retailprice").alias("rate_min"),
        (F.col("p_retailprice") * 1.5).alias("rate_max"),
        F.when(key % 10 >= 7, F.lit("citizen")).alias("visa_requirement"),
        (F.col("p_size") % 8).cast("double").alias("min_yoe"),
        (F.col("p_size") % 8 + 6).cast("double").alias("max_yoe"),
        _pick(key, JOB_STATUS_CYCLE).alias("status"),
        _days_after_2024(key).alias("created_at"),
    )


@_written
def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One placement per order with lines: rates of all its lines, candidate and job of the largest.

    The aggregate and the join share the hash partitioning of the order key.
    """
    line = _lines(
        spark, sf_dir, "l_orderkey", largest=("l_suppkey", "l_partkey", "l_linestatus", "l_returnflag")).select("l_orderkey", "bill", "pay", "l.*")
    stage = (
        F.when(F.col("o_orderstatus") == "O", F.lit("submitted"))
        .when(F.col("o_orderstatus") == "P", F.when(F.col("l_linestatus") == "O", F.lit("interview")).otherwise(F.lit("offer")))
        .otherwise(F.when(F.col("l_returnflag") == "R", F.lit("rejected")).otherwise(F.lit("hire")))
    )
    key = F.col("o_orderkey")
    return line.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == key).select(
        key.alias("id"),
        F.col("l_suppkey").alias("candidate_id"),
        F.col("l_partkey").alias("job_id"),
        F.when(key % 11 != 0, F.col("o_custkey") % 25).alias("recruiter_id"),
        F.col("o_custkey").alias("client_id"),
        stage.alias("stage"),
        F.lit(None).cast("double").alias("match_score"),
        F.lit(None).cast("string").alias("skill_gap"),
        *_rates(),
        F.col("o_orderdate").cast("timestamp").alias("submitted_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def _line_id() -> Column:
    """Unique id of the lines that share an order and a line number (1 to 7)."""
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


@_written
def payroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and line number: sums of all such lines, contractor of the largest."""
    return _lines(spark, sf_dir, "l_orderkey", "l_linenumber", largest=("l_suppkey",)).select(
        _line_id().alias("id"),
        F.col("l.l_suppkey").alias("contractor_id"),
        F.col("shipped").cast("date").alias("period"),
        *_rates(),
        ((F.col("bill") - F.col("pay")).cast("double") / F.col("bill").cast("double") * 100).alias("margin_pct"),
        F.col("shipped").cast("timestamp").alias("created_at"),
    )


@_written
def timesheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per order and line number, with the hours of all such lines."""
    hours = F.col("hours")
    over = hours > 48
    return _lines(spark, sf_dir, "l_orderkey", "l_linenumber", largest=("l_suppkey",)).select(
        _line_id().alias("id"),
        F.col("l.l_suppkey").alias("contractor_id"),
        F.date_trunc("week", F.col("shipped").cast("timestamp")).cast("date").alias("week_start"),
        hours.alias("hours"),
        F.greatest(hours - 40, F.lit(0.0)).alias("overtime_hours"),
        F.when(over, F.lit("flagged")).otherwise(F.lit("approved")).alias("status"),
        F.when(F.col("l_linenumber") != 7, over).alias("anomaly_flag"),
        F.when(over, hours / 64).alias("anomaly_score"),
        F.when(over, F.lit("hours beyond a usual week")).alias("anomaly_reason"),
        F.col("shipped").cast("timestamp").alias("created_at"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        _pick(F.col("user_id"), ENTITY_CYCLE).alias("entity_type"),
        F.col("user_id").alias("entity_id"),
        F.col("event_type").alias("model_name"),
        F.col("value").alias("score"),
        F.col("props").alias("features"),
        F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("created_at"),
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with resume lines in front, chosen by doc_id."""
    d = F.col("doc_id")

    def choose(mod: int, values: dict[int, str]) -> Column:
        return _pick(d, [values.get(i) for i in range(mod)])

    email = F.concat(F.lit("User."), d.cast("string"), F.lit("+cv@Example.CO.UK"))
    lines = [
        choose(5, {0: "Jane Doe", 1: "Omar Ali Khan", 2: "Müller, André", 3: "José García", 4: ""}),
        F.when(d % 3 == 0, email),
        choose(4, {0: "(555) 123-4567", 1: "555.987.6543"}),
        choose(8, {0: "US Citizen", 1: "Green Card holder", 2: "H-1B visa", 3: "F1 OPT",
                   4: "STEM OPT extension", 5: "EAD card", 6: "Team lead, F1 OPT"}),
        choose(6, {0: "Jan 2018 - Dec 2021\nJan 2022 - Present", 1: "2018 - 2022, 2020 - 2024",
                   2: "10+ years of experience", 3: "2020 - 2020, 2019 - 2023", 4: "2019 — 2023"}),
        choose(7, {0: "Python, AWS, k8s and Node.js", 1: "ReactJS; scikit-learn; SQL",
                   2: "C# and .NET, asp.net", 3: "épython, go-getter, ML, CV",
                   4: "CI/CD, GitHub Actions, Power BI",
                   5: "Apache Spark, Apache Kafka, PostgreSQL"}),
    ]
    return documents(spark, sf_dir).select(
        "doc_id", F.concat_ws("\n", *lines, "text").alias("text"), "source",
    )


def resume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of resume files with mixed extensions, folders and text, from documents."""
    d = F.col("doc_id")
    ext = _pick(d, ("pdf", "docx", "doc", "PDF", "txt", "png"))
    folder = F.when(d % 7 == 0, F.lit("resumes/old")).otherwise(F.lit("resumes"))
    text = F.when(d % 13 == 0, F.lit(" \n\t ")).otherwise(F.col("text"))
    return documents(spark, sf_dir).select(
        F.concat(folder, F.lit("/cv "), d.cast("string"), F.lit("."), ext).alias("path"),
        d.alias("doc_id"),
        text.alias("text"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (operation, elapsed_ms): half of them in five large operations, half in many small ones."""
    events = table(spark, sf_dir, "events")
    large, ms = F.col("event_type"), F.col("value").alias("elapsed_ms")
    small = F.concat_ws("_", F.lit("user"), F.col("user_id").cast("string"), large)
    return events.select(large.alias("operation"), ms).unionByName(events.select(small.alias("operation"), ms))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, one file or a folder of them, as a file stream.

    The path is a pattern for the one name: Spark takes a plain path of a stream for a folder, and refuses a file.
    """
    return spark.readStream.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def event_fields(events: DataFrame) -> DataFrame:
    """Application events, with the fields of all four event kinds, from the events table."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = F
    for source, name in KIND_OF_EVENT.items():
        kind = kind.when(F.col("event_type") == source, F.lit(name))
    message = _pick(e, ("embed took 1200ms", "db_query", "Slow parse", "TIMEOUT on fetch", "ok", "done"))
    return events.select(
        e.alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", F.lit("ERROR"))
        .when(F.col("event_type") == "view", F.lit("WARNING"))
        .otherwise(F.lit("INFO")).alias("level"),
        message.alias("msg"),
        u.cast("string").alias("request_id"),
        kind.alias("event"),
        (F.col("value") * 8).alias("duration_ms"),
        u.alias("candidate_id"),
        F.lit("pdf").alias("file_type"),
        (e % 12).cast("int").alias("skills_found"),
        (e % 20).cast("double").alias("yoe"),
        _pick(u, VISA_CYCLE).alias("visa_status"),
        (e % 9 != 0).alias("success"),
        F.when(F.col("event_type") == "error", F.lit("timeout")).alias("error"),
        _pick(u, ENTITY_CYCLE).alias("entity_type"),
        u.alias("entity_id"),
        F.lit(384).alias("dim"),
        F.concat(F.lit("q"), (e % 7).cast("string")).alias("query_name"),
        (e % 1000).cast("int").alias("row_count"),
        F.concat(F.lit("model_"), (e % 3).cast("string")).alias("model_name"),
        ((e % 10000) / 10000 + 0.00003).alias("score"),
    )
