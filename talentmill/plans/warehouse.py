"""One object for a folder of domain tables: every read query and every batch write."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partialmethod

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import candidate_embed_text, job_embed_text
from ..functions.vectors import hash_embed
from ..operators import aggregates, joins, parsing, quality, scans, writes
from ..schemas import EMBEDDING_DIM, TABLES
from ..session import materialise
from ..sources import tables, timings


class Warehouse:
    """Reads are lazy DataFrames; writes run a job and return the rejected rows, if any."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.root, name)

    # Reads

    def get_candidates(self, active_only: bool = False) -> DataFrame:
        return scans.get_candidates(self.table("candidates"), active_only)

    def get_jobs(self, status: str | None = None) -> DataFrame:
        return scans.get_jobs(self.table("jobs"), status)

    def get_open_jobs(self) -> DataFrame:
        return self.get_jobs("open")

    def get_clients(self) -> DataFrame:
        return scans.get_clients(self.table("clients"))

    def get_recruiters(self) -> DataFrame:
        return scans.get_recruiters(self.table("recruiters"))

    def get_placements(
        self, client_id: int | None = None, recruiter_id: int | None = None, stage: str | None = None
    ) -> DataFrame:
        return scans.get_placements(self.table("placements"), client_id, recruiter_id, stage)

    def get_timesheets(self, contractor_id: int | None = None, flagged_only: bool = False) -> DataFrame:
        return scans.get_timesheets(self.table("timesheets"), contractor_id, flagged_only)

    def get_payroll(self, contractor_id: int | None = None) -> DataFrame:
        return scans.get_payroll(self.table("payroll"), contractor_id)

    def get_latest_predictions(self, model_name: str, entity_type: str | None = None) -> DataFrame:
        return scans.get_latest_predictions(self.table("predictions"), model_name, entity_type)

    def _by_id(self, key: int, name: str) -> DataFrame:
        return scans.equals(self.table(name), id=key)

    get_candidate_by_id = partialmethod(_by_id, name="candidates")
    get_job_by_id = partialmethod(_by_id, name="jobs")
    get_client_by_id = partialmethod(_by_id, name="clients")

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        return scans.by_keys(self.table(name), keys)

    def get_placement_funnel_counts(self, client_id: int | None = None) -> DataFrame:
        return aggregates.placement_funnel_counts(self.table("placements"), client_id)

    def get_monthly_revenue(self) -> DataFrame:
        return aggregates.monthly_revenue(self.table("payroll"))

    def get_margin_leakage(self, threshold: float = 15.0) -> DataFrame:
        return aggregates.margin_leakage_clients(self.table("clients"), threshold)

    def get_margin_leakage_by_payroll(self, threshold: float = 15.0, dedup: bool = False) -> DataFrame:
        return aggregates.margin_leakage(
            self.table("payroll"), self.table("candidates"), self.table("placements"),
            self.table("clients"), threshold, dedup,
        )

    def get_placement_detail(self) -> DataFrame:
        names = ("placements", "candidates", "jobs", "clients", "recruiters")
        return joins.placement_detail(*[self.table(n) for n in names])

    def check_contracts(self, *names: str) -> DataFrame:
        return quality.contract_violations({n: self.table(n) for n in names or TABLES})

    # Writes

    def create(self, batch: DataFrame, name: str, natural_key: tuple[str, ...]) -> DataFrame:
        """Append a batch with defaults and new ids; returns the rows that break a rule.

        The natural key must be unique in the batch. The filled batch is written to the shared
        folder first, so that defaults such as the time are fixed, and a row number decides
        which of two rows with one unique value is the earlier. Rejected are also rows that
        repeat a unique value or link to no parent.
        """
        filled = writes.with_defaults(batch.drop("id"), TABLES[name]).drop("id")
        filled = materialise(filled.withColumn("_order", F.monotonically_increasing_id()), f"batch-{name}")
        parents = {parent: self.table(parent).select("id") for parent in TABLES[name].links.values()}
        valid, broken = quality.split_insertable(filled, name, self.table(name), parents, "_order")
        valid = materialise(valid.drop("_order"), f"new-{name}")
        broken = materialise(broken.drop("_order"), f"rejected-{name}")
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in natural_key])
        last = F.coalesce(self.table(name).agg(F.max("id")).scalar(), F.lit(0))
        tables.append_rows(writes.assign_ids(valid.withColumn("_key", key), "_key", last), self.root, name)
        return broken

    create_candidates = partialmethod(create, name="candidates", natural_key=("resume_path", "name", "email"))
    create_jobs = partialmethod(create, name="jobs", natural_key=("client_id", "title"))
    create_clients = partialmethod(create, name="clients", natural_key=("name",))
    create_recruiters = partialmethod(create, name="recruiters", natural_key=("email",))
    create_placements = partialmethod(create, name="placements", natural_key=("candidate_id", "job_id", "submitted_at"))
    create_timesheets = partialmethod(create, name="timesheets", natural_key=("contractor_id", "week_start"))
    create_payroll = partialmethod(create, name="payroll", natural_key=("contractor_id", "period"))

    def save_predictions(self, scored: DataFrame, model_name: str, features: list[str]) -> DataFrame:
        rows = writes.prediction_rows(scored, model_name, features)
        return self.create(rows, "predictions", ("entity_type", "entity_id", "model_name"))

    def _write_changes(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the id buckets that hold the keys, and publish them together."""
        tables.bucketed(self.spark, self.root, name).update(keys, TABLES[name].schema, change)

    def update(self, changes: DataFrame, name: str, fields: list[str]) -> DataFrame:
        """Apply keyed changes to a table; returns those without a row or that break a rule.

        Checks cover values, links and unique columns (see quality.split_updates). Only the buckets of changed ids are written.
        """
        current = self.table(name)
        parents = {p: self.table(p).select("id") for c, p in TABLES[name].links.items() if c in fields}
        valid, broken = quality.split_updates(changes, name, fields, current, parents)
        valid = materialise(valid, f"valid-{name}")
        lost = writes.unmatched_changes(current, valid).withColumn("broken_rules", F.array(F.lit("unknown id")))
        lost = materialise(lost.unionByName(broken), f"lost-{name}")
        self._write_changes(name, valid, lambda rows: writes.apply_changes(rows, valid, fields))
        return lost

    def update_candidates(self, changes: DataFrame, fields: list[str]) -> DataFrame:
        return self.update(changes, "candidates", fields)

    def update_placement_stages(self, changes: DataFrame) -> DataFrame:
        current = self.table("placements")
        lost = materialise(writes.rejected_stages(current, changes), "lost-stages")
        self._write_changes("placements", changes, lambda rows: writes.change_stages(rows, changes))
        return lost

    def flag_timesheet_anomalies(self, findings: DataFrame) -> DataFrame:
        """Flag the sheets with findings; returns the findings that match no sheet or several."""
        sheets = self.table("timesheets")
        lost = materialise(writes.rejected_findings(sheets, findings), "lost-findings")
        self._write_changes("timesheets", findings, lambda rows: writes.flag_anomalies(rows, findings))
        return lost

    def ingest_resumes(self, files: DataFrame, as_of_year: int) -> DataFrame:
        """Parse (path, text) files into candidates; returns the outcome of every file.

        The counts of the job are observed while it writes, and stored as a row of job_timings.
        """
        seen, start = Observation("ingest_resumes"), time.perf_counter()
        ingested = materialise(parsing.observed(parsing.ingest_files(files, as_of_year), seen), "ingest")
        self.create_candidates(parsing.candidate_rows(ingested))
        timings.record(self.spark, self.root, "ingest_resumes", time.perf_counter() - start, seen.get)
        return ingested.select("path", "status", "error")

    def job_timings(self) -> DataFrame:
        """One row per run of a write job: operation, elapsed_ms, n_rows, n_failed, finished_at."""
        return timings.read(self.spark, self.root)

    def get_job_latencies(self) -> DataFrame:
        """Calls, mean, extremes, total and p95 of the write jobs that have run here."""
        return aggregates.latency_stats(self.job_timings())

    def embeddings(self, name: str) -> DataFrame:
        """Newest stored embedding of every row of a table: id, embedding."""
        return tables.read_embeddings(self.spark, self.root, name)

    def _embed(self, name: str, text: Column, force: bool) -> int:
        """Embed rows without a stored embedding and append the vectors; the table itself is only read."""
        seen, start, rows = Observation(f"embed_{name}"), time.perf_counter(), self.table(name)
        todo = rows if force else rows.join(self.embeddings(name).select("id"), "id", "left_anti")
        vectors = hash_embed(todo.select("id", text.alias("text")), dim=EMBEDDING_DIM)
        tables.append_embeddings(vectors.observe(seen, F.count("*").alias("rows")), self.root, name)
        done = seen.get.get("rows", 0)
        timings.record(self.spark, self.root, f"embed_{name}", time.perf_counter() - start, {"rows": done})
        return done

    def embed_candidates(self, force: bool = False) -> int:
        """Embed the candidates without an embedding, or all; returns their number."""
        text = candidate_embed_text(
            F.col("resume_text"), F.col("skills"), F.col("location"), F.col("visa_status"), F.col("yoe")
        )
        return self._embed("candidates", text, force)

    def embed_jobs(self, force: bool = False) -> int:
        text = job_embed_text(
            F.col("title"), F.col("jd_text"), F.col("required_skills"), F.col("location"), F.col("min_yoe")
        )
        return self._embed("jobs", text, force)

    def reset(self) -> None:
        """Empty all tables but users."""
        tables.reset_tables(self.spark, self.root)
