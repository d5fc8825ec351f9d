"""The query catalogue: every operator over the supplied tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as rules
from ..functions import vectors
from ..operators import aggregates, derived, events, joins, parsing, quality, scans, seed, similarity, writes
from ..schemas import STAGES, TABLES
from ..session import shared_dir
from ..sources import star_views as v
from ..sources import files, logs, tables
from ..streaming import jobs as streams
from . import insights
from .warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF_YEAR = 2026
AS_OF = "2000-06-15"
LEAK_THRESHOLD = 4.9
PAIR_THRESHOLD = 0.2
NEIGHBOUR_THRESHOLD = 0.3
STREAM_DIM = 32


def plain(df: DataFrame) -> DataFrame:
    """Dates, times and string lists as text, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf: plain(f(spark, sf))
    return f


# Scans and lookups

@query
def scan_candidates(spark, sf):
    return scans.get_candidates(v.candidates(spark, sf), active_only=True)


@query
def scan_jobs(spark, sf):
    return scans.get_jobs(v.jobs(spark, sf))


@query
def open_jobs(spark, sf):
    return scans.get_open_jobs(v.jobs(spark, sf))


@query
def scan_clients(spark, sf):
    return scans.get_clients(v.clients(spark, sf))


@query
def scan_recruiters(spark, sf):
    return scans.get_recruiters(v.recruiters(spark, sf))


@query
def placements_filtered(spark, sf):
    return scans.get_placements(v.placements(spark, sf), recruiter_id=0, stage="hire")


@query
def timesheets_flagged(spark, sf):
    return scans.get_timesheets(v.timesheets(spark, sf), flagged_only=True)


@query
def payroll_by_contractor(spark, sf):
    return scans.get_payroll(v.payroll(spark, sf), contractor_id=0)


@query
def predictions_history(spark, sf):
    return scans.get_latest_predictions(v.predictions(spark, sf), "error", "client")


@query
def latest_prediction_per_entity(spark, sf):
    return scans.newest_per_entity(v.predictions(spark, sf))


def _order_keys(spark, sf, key: Column) -> DataFrame:
    return v.table(spark, sf, "orders").where(F.col("o_totalprice") > 450000).select(key.alias("id"))


@query
def lookup_by_keys(spark, sf):
    return scans.get_clients(scans.by_keys(v.clients(spark, sf), _order_keys(spark, sf, F.col("o_custkey"))))


@query
def missing_keys(spark, sf):
    return scans.missing_keys(_order_keys(spark, sf, F.col("o_custkey") * 2), v.clients(spark, sf))


# Aggregates and joins

@query
def funnel_counts(spark, sf):
    return aggregates.placement_funnel_counts(v.placements(spark, sf))


@query
def funnel_counts_client(spark, sf):
    return aggregates.placement_funnel_counts(v.placements(spark, sf), client_id=65)


@query
def monthly_revenue(spark, sf):
    return aggregates.monthly_revenue(v.payroll(spark, sf))


@query
def monthly_headcount_distinct(spark, sf):
    return aggregates.monthly_headcount_distinct(v.payroll(spark, sf))


@query
def margin_leakage_clients(spark, sf):
    return aggregates.margin_leakage_clients(v.clients(spark, sf))


def _leakage(spark, sf, dedup: bool) -> DataFrame:
    return aggregates.margin_leakage(
        v.payroll(spark, sf), v.candidates(spark, sf), v.placements(spark, sf), v.clients(spark, sf),
        LEAK_THRESHOLD, dedup,
    )


@query
def margin_leakage_fanout(spark, sf):
    return _leakage(spark, sf, dedup=False)


@query
def margin_leakage_dedup(spark, sf):
    return _leakage(spark, sf, dedup=True)


@query
def op_latency_stats(spark, sf):
    return aggregates.latency_stats(v.timings(spark, sf))


@query
def active_contractors(spark, sf):
    return aggregates.active_contractors(v.candidates(spark, sf))


@query
def placement_detail(spark, sf):
    return joins.placement_detail(
        v.placements(spark, sf), v.candidates(spark, sf), v.jobs(spark, sf), v.clients(spark, sf),
        v.recruiters(spark, sf),
    )


@query
def jobs_per_client(spark, sf):
    return joins.children_per_parent(v.jobs(spark, sf), v.clients(spark, sf), "client_id", "jobs")


@query
def timesheets_per_candidate(spark, sf):
    return joins.children_per_parent(
        v.timesheets(spark, sf), v.candidates(spark, sf), "contractor_id", "timesheets"
    )


# Derived measures and contracts

@query
def margin_calc(spark, sf):
    return derived.with_margins(v.payroll(spark, sf)).select(
        "id", "contractor_id", "bill_rate", "pay_rate", "margin", "margin_pct"
    )


@query
def overtime(spark, sf):
    return v.timesheets(spark, sf).select(
        "id", "contractor_id", "hours", derived.overtime(F.col("hours") * 1.15).alias("overtime_hours")
    )


@query
def weekly_hours(spark, sf):
    return aggregates.weekly_hours(v.timesheets(spark, sf))


@query
def contract_violations(spark, sf):
    """All tables, with planted faults: off-domain values, missing parents, doubled ids."""
    placements = v.placements(spark, sf).withColumns({
        "stage": F.when(F.col("id") % 17 == 0, F.lit("lost")).otherwise(F.col("stage")),
        "job_id": F.when(F.col("id") % 19 == 0, F.lit(-1)).otherwise(F.col("job_id")),
        "client_id": F.when(F.col("id") % 23 != 0, F.col("client_id")),
    })
    clients = v.clients(spark, sf).withColumn(
        "name", F.when(F.col("id") % 29 == 0, F.repeat("name", 20)).otherwise(F.col("name"))
    )
    return quality.contract_violations({
        "clients": clients,
        "recruiters": v.recruiters(spark, sf),
        "candidates": v.candidates(spark, sf),
        "jobs": v.jobs(spark, sf),
        "placements": placements,
        "timesheets": v.timesheets(spark, sf),
        "payroll": v.payroll(spark, sf),
        "predictions": v.predictions(spark, sf),
    })


# Text rules

def _resume_fields(spark, sf, **fields: Column) -> DataFrame:
    rows = v.resumes(spark, sf).withColumn("lowered", F.lower("text"))
    if any(name == "skills" for name in fields):
        rows = rows.withColumn("hits", rules.vocabulary_hits(F.col("lowered")))
    return rows.select("doc_id", *[c.alias(name) for name, c in fields.items()])


@query
def extract_email(spark, sf):
    return _resume_fields(spark, sf, email=rules.extract_email(F.col("text")))


@query
def extract_phone(spark, sf):
    return _resume_fields(spark, sf, phone=rules.extract_phone(F.col("text")))


@query
def extract_name(spark, sf):
    return _resume_fields(spark, sf, name=rules.extract_name(F.col("text")))


@query
def extract_skills(spark, sf):
    return _resume_fields(spark, sf, skills=rules.extract_skills(F.col("lowered"), F.col("hits")))


@query
def extract_yoe(spark, sf):
    return _resume_fields(spark, sf, yoe=rules.extract_yoe(F.col("text"), AS_OF_YEAR))


@query
def extract_visa(spark, sf):
    return _resume_fields(spark, sf, visa_status=rules.extract_visa(F.col("lowered")))


@query
def normalise_skill(spark, sf):
    """Free-form skill items of the resumes' comma and semicolon lists."""
    items = v.resumes(spark, sf).select("doc_id", F.explode(F.split("text", "[,;\n]")).alias("raw"))
    return items.select("doc_id", "raw", rules.normalise_skill(F.col("raw")).alias("skill"))


@query
def skill_frequency(spark, sf):
    return aggregates.skill_frequency(parsing.parse_documents(v.resumes(spark, sf), AS_OF_YEAR))


@query
def parse_documents(spark, sf):
    """Flagship: contacts, skills, experience and visa status of every resume."""
    rows = v.resumes(spark, sf).withColumn(
        "text", F.when(F.col("doc_id") % 50 == 49, F.lit(" \n\t")).otherwise(F.col("text"))
    )
    return parsing.parse_documents(rows, AS_OF_YEAR).drop("text", "source")


@query
def candidate_embed_text(spark, sf):
    parsed = parsing.parse_documents(v.resumes(spark, sf), AS_OF_YEAR)
    return parsed.select("doc_id", rules.candidate_embed_text(
        F.col("text"), F.col("skills"), F.col("source"), F.col("visa_status"), F.col("yoe")
    ).alias("embed_text"))


@query
def job_embed_text(spark, sf):
    return v.jobs(spark, sf).select("id", rules.job_embed_text(
        F.col("title"), F.col("jd_text"), F.col("required_skills"), F.col("location"), F.col("min_yoe")
    ).alias("embed_text"))


@query
def truncate_text(spark, sf):
    return v.resumes(spark, sf).select("doc_id", rules.truncate_at_sentence(F.col("text"), 800).alias("cut"))


@query
def safe_filename(spark, sf):
    stamp = F.lit("2026-06-01 12:00:00").cast("timestamp")
    return v.resume_files(spark, sf).select("path", rules.safe_filename(F.col("path"), stamp).alias("stored_as"))


@query
def route_by_type(spark, sf):
    return parsing.route_files(v.resume_files(spark, sf)).select("path", "file_type", "decoder", "error")


@query
def resume_files_listed(spark, sf):
    return parsing.list_resume_files(v.resume_files(spark, sf), "resumes").select("path")


@query
def parse_outcomes(spark, sf):
    return aggregates.outcome_counts(parsing.ingest_files(v.resume_files(spark, sf), AS_OF_YEAR))


def _stored_files(spark, sf) -> str:
    """A folder with the resume files as files; every eleventh of them is no UTF-8."""
    folder = shared_dir(spark, "files")
    body = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("FF")), body)
    rows = v.resume_files(spark, sf).select(
        "path", F.when(F.col("doc_id") % 11 == 0, broken).otherwise(body).alias("content"))
    files.save_files(rows, folder).write.format("noop").mode("overwrite").save()
    return folder


def _file_name() -> Column:
    return F.regexp_extract("path", "([^/]+)$", 1).alias("file")


@query
def stored_files_listed(spark, sf):
    return files.list_files(spark, f"{_stored_files(spark, sf)}/resumes").select(_file_name(), "length")


@query
def stored_files_loaded(spark, sf):
    """The bytes of all files of two folders, whatever their type."""
    folder = _stored_files(spark, sf)
    loaded = files.load_files(spark, [f"{folder}/resumes", f"{folder}/resumes/old"])
    return loaded.select(_file_name(), "length", F.md5("content").alias("digest"))


def _utf8(content: bytes) -> str:
    return content.decode("utf-8")


@query
def stream_files(spark, sf):
    """Resume files as a stream, decoded and parsed; those that no decoder could read are in quarantine."""
    folder, work = _stored_files(spark, sf), shared_dir(spark, "ingest")
    streams.ingest_file_stream(
        files.stream_resume_files(spark, f"{folder}/resumes"), f"{work}/store", f"{work}/checkpoint", {"pdf": _utf8, "docx": _utf8}, AS_OF_YEAR)
    good, bad = (streams.read_ingested(spark, f"{work}/store", quarantined=q) for q in (False, True))
    return good.unionByName(bad).select(
        _file_name(), "status", F.regexp_extract("error", "^[A-Za-z ]+", 0).alias("problem"), "email", "yoe", "visa_status", "skills",
        F.md5(F.encode("text", "UTF-8")).alias("digest"))


# Event logs

def _event_rows(spark, sf) -> DataFrame:
    return v.event_fields(v.table(spark, sf, "events"))


def _lines(spark, sf) -> DataFrame:
    """Log lines of all events; some are blank, some are cut off."""
    rows = _event_rows(spark, sf)
    text = F.to_json(F.struct("ts", "level", "msg", "request_id", "event", "duration_ms"))
    line = (
        F.when(F.col("event_id") % 89 == 0, F.lit("  "))
        .when(F.col("event_id") % 97 == 0, F.concat(F.lit("cut "), F.col("event_id").cast("string"), F.lit(" {")))
        .otherwise(text)
    )
    return rows.select(F.col("event_id").alias("line_no"), F.col("ts").alias("at"), line.alias("line"))


@query
def events_typed(spark, sf):
    """Event records written as JSON lines and read back with the typed schema."""
    records = events.event_records(_event_rows(spark, sf), keep=("event_id",))
    lines = events.to_lines(records, keep=("event_id",))
    return events.parse_lines(lines).drop("logger", "exception")


@query
def tail_events(spark, sf):
    return events.tail(_lines(spark, sf), ("at", "line_no"), 200).select(
        "line_no", "level", "msg", "request_id", "event", "duration_ms"
    )


TAIL = 200


@query
def tail_files(spark, sf):
    """The last physical lines of log files that Spark has written in time order, broken and blank lines included."""
    folder = shared_dir(spark, "logs")
    _lines(spark, sf).repartitionByRange("at", "line_no").sortWithinPartitions("at", "line_no").select("line").write.text(folder)
    return logs.tail_log(spark, folder, TAIL, "*.txt").select("ts", "level", "msg", "request_id", "event", "duration_ms")


@query
def slow_queries(spark, sf):
    return events.slow_queries(events.event_records(_event_rows(spark, sf)))


@query
def slow_ops(spark, sf):
    return events.slow_operations(_event_rows(spark, sf)).select("event_id", "level", "msg")


@query
def log_stats(spark, sf):
    """Lines and bytes of the documents' text, one log per source."""
    lines = v.documents(spark, sf).select(
        F.col("source").alias("log"), F.explode(F.split("text", "\n")).alias("line")
    )
    return events.log_stats(lines)


# Writes

@query
def append_with_defaults(spark, sf):
    """New candidates from parsed files: ids after the stored ones, defaults filled in."""
    new = parsing.candidate_rows(parsing.ingest_files(v.resume_files(spark, sf), AS_OF_YEAR))
    last = v.table(spark, sf, "supplier").agg(F.max("s_suppkey")).scalar()
    rows = writes.with_defaults(writes.assign_ids(new, "resume_path", last), TABLES["candidates"])
    return rows.select(
        "id", "name", "email", "skills", "visa_status", "yoe", "rate", "resume_path", "is_active_contractor",
    )


@query
def insert_rejects(spark, sf):
    """A batch of recruiters with repeated mails, and one of jobs of which many have no client."""
    c, p = F.col("c_custkey"), F.col("p_partkey")
    people = v.table(spark, sf, "customer").select(
        c.alias("order"), F.col("c_name").alias("name"),
        F.when(c % 50 == 0, F.concat(F.lower(F.lit("NATION_0")), F.lit("@example.com")))
        .when(c % 9 != 0, F.concat(F.lit("m"), (c % 700).cast("string"), F.lit("@example.com"))).alias("email"))
    parts = v.table(spark, sf, "part").select(
        p.alias("order"), F.when(p % 31 != 0, F.col("p_name")).alias("title"), (p * 3).alias("client_id"),
        F.when(p % 17 == 0, F.lit("lost")).otherwise(F.lit("open")).alias("status"))
    stored = v.recruiters(spark, sf), v.jobs(spark, sf)
    rejects = [
        quality.split_insertable(batch, name, rows, {"clients": v.clients(spark, sf)}, "order")[1].select(
            F.lit(name).alias("table"), "order", F.array_join("broken_rules", ",").alias("rules"))
        for name, batch, rows in (("recruiters", people, stored[0]), ("jobs", parts, stored[1]))]
    return rejects[0].unionByName(rejects[1])


@query
def update_rejects(spark, sf):
    """Candidate changes that set an unknown visa status, an empty name or too long a phone number."""
    e = F.col("event_id")
    changes = v.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), e.alias("seq"),
        F.when(e % 3 == 0, F.array(F.lit("visa_status"))).when(e % 3 == 1, F.array(F.lit("name"), F.lit("phone")))
        .otherwise(F.array(F.lit("name"))).alias("set_fields"),
        F.when(e % 4 == 0, F.lit("martian")).otherwise(F.lit("gc")).alias("visa_status"),
        F.when(e % 5 != 0, F.col("event_type")).alias("name"), F.repeat(F.lit("5"), (e % 60).cast("int")).alias("phone"))
    candidates = quality.split_changes(changes, "candidates", ["visa_status", "name", "phone"])[1]
    people = quality.split_updates(_recruiter_changes(spark, sf), "recruiters", ["email", "team"], v.recruiters(spark, sf), {})[1]
    e = F.col("event_id")
    moved = v.table(spark, sf, "events").select(
        (e % 500).alias("id"), e.alias("seq"), F.col("ts").cast("timestamp").alias("changed_at"),
        F.when(e % 5 == 0, F.array(F.lit("location"))).otherwise(F.array(F.lit("client_id"))).alias("set_fields"),
        F.when(e % 7 != 0, e * 3).alias("client_id"), F.lit("here").alias("location"))
    jobs = quality.split_updates(moved, "jobs", ["client_id", "location"], v.jobs(spark, sf), {"clients": v.clients(spark, sf).select("id")})[1]
    return reduce(DataFrame.union, [
        rows.select(F.lit(name).alias("table"), "id", "seq", F.array_join("broken_rules", ",").alias("rules"))
        for name, rows in (("candidates", candidates), ("recruiters", people), ("jobs", jobs))])


def _recruiter_changes(spark, sf) -> DataFrame:
    """Some recruiters change their team or take a mail, of which some are held, freed or wanted by several."""
    e = F.col("event_id")
    return v.table(spark, sf, "events").where("event_id % 40 < 15 or event_id % 3 = 0").select(
        (e % 40).alias("id"), e.alias("seq"), F.col("ts").cast("timestamp").alias("changed_at"),
        F.when(e % 3 == 0, F.array(F.lit("team"))).otherwise(F.array(F.lit("email"))).alias("set_fields"),
        F.when(e % 11 != 0, F.concat(F.lit("nation_"), (e * 7 % 34).cast("string"), F.lit("@example.com"))).alias("email"),
        F.lit("new").alias("team"))


@query
def written_updates(spark, sf):
    """Candidates written in id buckets, updated there in two batches, and read back."""
    house = Warehouse(spark, shared_dir(spark, "updated"))
    rows = v.candidates(spark, sf).withColumn("updated_at", F.col("created_at"))
    tables.append_rows(writes.with_defaults(rows, TABLES["candidates"]), house.root, "candidates")
    changes = _candidate_changes(spark, sf)
    for part in (0, 1):
        house.update_candidates(changes.where(F.col("id") % 2 == part), ["location", "rate"])
    return house.table("candidates").select("id", "name", "location", "rate", "updated_at")


@query
def job_metrics(spark, sf):
    """Jobs that filled a new warehouse from the resume files, with the rows that they observed."""
    house = Warehouse(spark, shared_dir(spark, "jobs"))
    tables.bucketed(spark, house.root, "candidates").clear()
    house.ingest_resumes(v.resume_files(spark, sf), AS_OF_YEAR)
    house.embed_candidates()
    calls = house.get_job_latencies().select("operation", "calls")
    return house.job_timings().where("elapsed_ms > 0").groupBy("operation").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_failed").alias("n_failed")).join(calls, "operation")


@query
def written_reset(spark, sf):
    """Rows per table after two tables were written, all were emptied, and one was written again."""
    house = Warehouse(spark, shared_dir(spark, "reset"))
    filled = {n: writes.with_defaults(rows, TABLES[n]) for n, rows in (
        ("clients", v.clients(spark, sf)), ("recruiters", v.recruiters(spark, sf)))}
    for name, rows in filled.items():
        tables.append_rows(rows, house.root, name)
    house.reset()
    tables.append_rows(filled["clients"], house.root, "clients")
    return reduce(DataFrame.union, [
        house.table(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n in TABLES if n != "users"])


@query
def written_predictions(spark, sf):
    """Predictions written to the shared folder by model, appended to, and read back for one model."""
    path = shared_dir(spark, "predictions")
    rows = v.predictions(spark, sf).withColumn("created_at", F.coalesce("created_at", F.lit("2000-01-01").cast("timestamp")))
    tables.append_rows(rows.where("id % 2 = 0"), path, "predictions")
    tables.append_rows(rows.where("id % 2 = 1"), path, "predictions")
    return tables.read_table(spark, path, "predictions").where("model_name = 'purchase'").select("id", "entity_type", "entity_id", "score")


@query
def stored_embeddings(spark, sf):
    """Two runs of embeddings appended for the documents, the second for every third one; the newest count."""
    path = shared_dir(spark, "embeddings")
    rows = _vectors(spark, sf)
    tables.append_embeddings(rows, path, "documents")
    tables.append_embeddings(rows.where("id % 3 = 0").withColumn("embedding", F.reverse("embedding")), path, "documents")
    return _nonzero(tables.read_embeddings(spark, path, "documents"), "id")


@query
def predictions_written(spark, sf):
    scored = insights.attrition_risk(v.candidates(spark, sf)).join(
        v.candidates(spark, sf).select("id", "tenure_days", "comms_gap_days"), "id"
    ).select(
        F.lit("candidate").alias("entity_type"), F.col("id").alias("entity_id"),
        F.col("attrition_risk_score").alias("score"), "tenure_days", "comms_gap_days",
    )
    return writes.prediction_rows(scored, "attrition", ["tenure_days", "comms_gap_days"])


def _candidate_changes(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    fields = (
        F.when(kind == "click", F.array(F.lit("location")))
        .when(kind == "view", F.array(F.lit("rate")))
        .when(kind == "purchase", F.array(F.lit("location"), F.lit("rate")))
        .otherwise(F.array().cast("array<string>"))
    )
    return v.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("changed_at"),
        F.col("event_id").alias("seq"), fields.alias("set_fields"),
        F.concat(F.lit("CITY_"), F.col("event_id").cast("string")).alias("location"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("rate"),
    )


@query
def upsert_entities(spark, sf):
    rows = v.candidates(spark, sf).withColumn("updated_at", F.col("created_at"))
    changed = writes.apply_changes(rows, _candidate_changes(spark, sf), ["location", "rate"])
    return changed.select("id", "name", "location", "rate", "updated_at")


@query
def upsert_rejects(spark, sf):
    return writes.unmatched_changes(v.candidates(spark, sf), _candidate_changes(spark, sf)).select("id", "seq")


def _stage_changes(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return v.table(spark, sf, "events").select(
        (e * 2).alias("id"), F.get(F.array(*[F.lit(s) for s in (*STAGES, "bogus")]), (e % 6).cast("int")).alias("stage"),
        F.col("ts").cast("timestamp").alias("changed_at"), e.alias("seq"),
    )


@query
def stage_update(spark, sf):
    return writes.change_stages(v.placements(spark, sf), _stage_changes(spark, sf)).select("id", "stage", "updated_at")


@query
def stage_rejects(spark, sf):
    return writes.rejected_stages(v.placements(spark, sf), _stage_changes(spark, sf)).select("id", "stage", "reason")


@query
def flag_anomalies(spark, sf):
    sheets = v.timesheets(spark, sf)
    findings = insights.timesheet_findings(sheets, z_limit=1.65)
    return writes.flag_anomalies(sheets, findings).groupBy(
        "contractor_id", "status", "anomaly_flag", "anomaly_reason"
    ).agg(F.count("*").alias("sheets"), F.max("anomaly_score").alias("top_score"))


@query
def flag_rejects(spark, sf):
    """Findings whose id is unknown (every seventh is made so), or not unique (every fifth sheet is there twice)."""
    sheets = v.timesheets(spark, sf)
    findings = insights.timesheet_findings(sheets, z_limit=1.65)
    findings = findings.withColumn("id", F.when(F.col("id") % 7 == 0, -F.col("id")).otherwise(F.col("id")))
    twice = sheets.unionByName(sheets.where("id % 5 = 0"))
    return writes.rejected_findings(twice, findings).select("id", "reason", "rejected")


# Vectors

def _vectors(spark, sf) -> DataFrame:
    rows = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.spread(rows, "id")


def _nonzero(df: DataFrame, key: str) -> DataFrame:
    """Vectors as (key, bucket, weight) rows of their non-zero entries."""
    entries = df.select(key, F.posexplode("embedding").alias("bucket", "weight"))
    return entries.where(F.col("weight") != 0).withColumn("weight", F.col("weight").cast("double"))


@query
def hash_embed(spark, sf):
    return _nonzero(vectors.hash_embed(v.documents(spark, sf), "doc_id"), "doc_id")


@query
def embedding_quality(spark, sf):
    return vectors.embedding_quality(v.table(spark, sf, "embeddings"), 64)


@query
def cosine_topk(spark, sf):
    return similarity.cosine_topk(_vectors(spark, sf), 3)


@query
def cosine_neighbour_counts(spark, sf):
    return similarity.neighbour_counts(_vectors(spark, sf), NEIGHBOUR_THRESHOLD)


@query
def cosine_pairs_over(spark, sf):
    """Candidate-job pairs that occur as placements, with a similarity over the threshold."""
    pairs = v.placements(spark, sf).select("candidate_id", "job_id").distinct()
    stored = _vectors(spark, sf)
    scored = similarity.similarity_of_pairs(pairs, stored, stored, "candidate_id", "job_id")
    return scored.where(F.col("similarity") > PAIR_THRESHOLD)


# Demo data derived from the keys of the given tables

def _ids(spark, sf, name: str, key: str) -> DataFrame:
    return v.table(spark, sf, name).select(F.col(key).cast("long").alias("id"))


@query
def seed_clients(spark, sf):
    return seed.seed_clients(_ids(spark, sf, "customer", "c_custkey"))


@query
def seed_recruiters(spark, sf):
    return seed.seed_recruiters(_ids(spark, sf, "nation", "n_nationkey"))


@query
def seed_candidates(spark, sf):
    return seed.seed_candidates(_ids(spark, sf, "supplier", "s_suppkey"))


@query
def seed_jobs(spark, sf):
    n_clients = v.table(spark, sf, "customer").agg(F.count("*")).scalar()
    return seed.seed_jobs(_ids(spark, sf, "part", "p_partkey"), n_clients)


@query
def seed_placements(spark, sf):
    def rows(name: str) -> Column:
        return v.table(spark, sf, name).agg(F.count("*")).scalar()

    jobs = seed.seed_jobs(_ids(spark, sf, "part", "p_partkey"), rows("customer"))
    return seed.seed_placements(
        _ids(spark, sf, "orders", "o_orderkey"), rows("supplier"), rows("part"), rows("nation"), jobs, AS_OF)


def _seed_contractors(spark, sf) -> DataFrame:
    return scans.is_true(seed.seed_candidates(_ids(spark, sf, "supplier", "s_suppkey")), "is_active_contractor")


@query
def seed_timesheets(spark, sf):
    return seed.seed_timesheets(_seed_contractors(spark, sf), AS_OF)


@query
def seed_payroll(spark, sf):
    return seed.seed_payroll(_seed_contractors(spark, sf), AS_OF)


# Reports by this package's own definitions

@query
def match_scores(spark, sf):
    return insights.match_scores(v.placements(spark, sf), v.candidates(spark, sf), v.jobs(spark, sf))


@query
def best_candidates(spark, sf):
    """Candidates and open jobs embedded by their texts."""
    jobs, people = v.jobs(spark, sf), v.candidates(spark, sf)
    job_text = rules.job_embed_text(
        F.col("title"), F.col("jd_text"), F.col("required_skills"), F.col("location"), F.col("min_yoe")
    )
    person_text = rules.candidate_embed_text(
        F.lit(None).cast("string"), F.col("skills"), F.col("location"), F.col("visa_status"), F.col("yoe")
    )
    job_vectors = vectors.hash_embed(jobs.where(F.col("status") == "open").select("id", job_text.alias("text")))
    person_vectors = vectors.hash_embed(people.select("id", person_text.alias("text")))
    return insights.best_candidates(jobs.join(job_vectors, "id"), people.join(person_vectors, "id"), 3)


@query
def client_refresh(spark, sf):
    return insights.refresh_clients(v.clients(spark, sf), v.jobs(spark, sf), v.placements(spark, sf)).select(
        "id", "name", "req_volume", "margin_pct"
    )


@query
def landing_kpis(spark, sf):
    return insights.landing_kpis(v.jobs(spark, sf), v.candidates(spark, sf), v.placements(spark, sf), AS_OF)


@query
def timesheet_findings(spark, sf):
    return insights.timesheet_findings(v.timesheets(spark, sf), z_limit=1.65)


@query
def timesheet_robust_findings(spark, sf):
    return insights.robust_findings(v.timesheets(spark, sf), limit=1.5)


@query
def attrition_risk(spark, sf):
    return insights.attrition_risk(v.candidates(spark, sf))


@query
def client_churn(spark, sf):
    return insights.client_churn(v.placements(spark, sf), AS_OF, 180)


@query
def revenue_forecast(spark, sf):
    return insights.revenue_forecast(v.payroll(spark, sf))


@query
def recruiter_kpis(spark, sf):
    return insights.recruiter_kpis(v.placements(spark, sf), v.recruiters(spark, sf))


@query
def funnel_conversion(spark, sf):
    return insights.funnel_conversion(v.placements(spark, sf))


@query
def visa_compliance(spark, sf):
    return insights.visa_compliance(v.candidates(spark, sf))


@query
def hire_rates(spark, sf):
    return insights.hire_rates(v.placements(spark, sf), v.jobs(spark, sf))


@query
def executive_summary(spark, sf):
    return insights.executive_summary(
        v.jobs(spark, sf), v.candidates(spark, sf), v.placements(spark, sf), v.clients(spark, sf),
        v.payroll(spark, sf), AS_OF,
    )


# Streams, run to the end of the given files

def _run_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = shared_dir(spark, "stream")
    streams.run_available(rows, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def _event_stream(spark, sf) -> DataFrame:
    return v.event_fields(v.stream_table(spark, sf, "events"))


@query
def stream_event_metrics(spark, sf):
    path = shared_dir(spark, "stream")
    streams.run_updates(streams.event_histogram(_event_stream(spark, sf)), f"{path}/out", f"{path}/checkpoint")
    return streams.event_metrics(streams.newest_state(spark, f"{path}/out", ["window_start", "window_end", "event", "bin"]))


@query
def stream_slow_ops(spark, sf):
    return _run_stream(spark, streams.slow_operation_alerts(_event_stream(spark, sf))).select("event_id", "level", "msg")


@query
def stream_without_duplicates(spark, sf):
    """The event stream delivered twice."""
    twice = _event_stream(spark, sf).unionByName(_event_stream(spark, sf))
    return _run_stream(spark, streams.without_duplicates(twice, ["event_id"])).select("event_id", "event")


@query
def stream_incremental_embed(spark, sf):
    path = shared_dir(spark, "embed")
    rows = v.stream_table(spark, sf, "documents").select("doc_id", "text")
    streams.incremental_load(
        rows, f"{path}/store", f"{path}/checkpoint", lambda b: vectors.hash_embed(b, "doc_id", dim=STREAM_DIM), "doc_id"
    )
    return _nonzero(streams.read_store(spark, f"{path}/store"), "doc_id")
