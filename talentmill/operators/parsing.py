"""Table-level resume parsing and file intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as rules
from ..functions.vocab import RESUME_TYPES
from ..schemas import VISA_STATUSES

PARSED = ("name", "email", "phone", "skills", "yoe", "visa_status")


def parse_documents(documents: DataFrame, as_of_year: int, text: str = "text") -> DataFrame:
    """Adds name, email, phone, skills, yoe, visa_status, status and error.

    A blank text yields status 'rejected' and null fields. Projections only, no shuffle;
    the lower-cased text and its vocabulary hits are computed once per row.
    """
    body = F.col(text)
    lowered, hits, blank = F.col("_lower"), F.col("_hits"), F.col("_blank")
    prepared = documents.withColumns({
        "_lower": F.lower(body), "_blank": rules.is_blank(body)
    }).withColumn("_hits", rules.vocabulary_hits(lowered))
    fields = {
        "name": F.coalesce(rules.extract_name(body), F.lit("Unknown")),
        "email": rules.extract_email(body),
        "phone": rules.extract_phone(body),
        "skills": rules.extract_skills(lowered, hits),
        "yoe": rules.extract_yoe(body, as_of_year),
        "visa_status": rules.extract_visa(lowered),
    }
    columns = {name: F.when(~blank, value) for name, value in fields.items()}
    columns["status"] = F.when(blank, F.lit("rejected")).otherwise(F.lit("parsed"))
    columns["error"] = F.when(blank, F.lit("no text"))
    return prepared.withColumns(columns).drop("_lower", "_hits", "_blank")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == "parsed").drop("status", "error")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") != "parsed")


def observed(parsed: DataFrame, metrics: Observation) -> DataFrame:
    """The same rows; once they are written, metrics holds their number and the outcome counts.

    The counts come with the job itself, without a second pass.
    """
    ok = F.col("status") == "parsed"
    return parsed.observe(
        metrics, F.count("*").alias("rows"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("failed")
    )


def list_resume_files(files: DataFrame, folder: str) -> DataFrame:
    """Files of an accepted type directly in a folder, in path order.

    Extensions match in any case.
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.where(
        (parent == folder.rstrip("/")) & rules.file_type(F.col("path")).isin(*RESUME_TYPES)
    ).orderBy("path")


def route_files(files: DataFrame) -> DataFrame:
    """Adds the decoder of each file and an error for unsupported types."""
    kind = rules.file_type(F.col("path"))
    route = rules.decoder_route(kind)
    return files.withColumns({
        "file_type": kind,
        "decoder": route,
        "error": F.when(route.isNull(), F.concat(F.lit("unsupported file type: "), kind)),
    })


def ingest_files(files: DataFrame, as_of_year: int) -> DataFrame:
    """Route, parse and label every file of a (path, text) table; failures stay as rows.

    status is 'parsed', 'rejected' (no text) or 'unsupported' (file type). Only parsed files have fields: there is
    no decoder for an unsupported one, so its text is not parsed.
    """
    routed = route_files(files).withColumnRenamed("error", "_unsupported")
    parsed = parse_documents(
        routed.withColumn("_decoded", F.when(F.col("_unsupported").isNull(), F.col("text"))), as_of_year, text="_decoded")
    status = F.when(F.col("_unsupported").isNotNull(), F.lit("unsupported")).otherwise(F.col("status"))
    return parsed.withColumns({
        "status": status, "error": F.coalesce("_unsupported", "error"),
    }).drop("_unsupported", "_decoded")


def candidate_rows(ingested: DataFrame) -> DataFrame:
    """Parsed files as new candidate rows; a visa value outside the domain becomes 'unknown'."""
    visa = F.when(F.col("visa_status").isin(*VISA_STATUSES), F.col("visa_status")).otherwise(F.lit("unknown"))
    return ingested.where(F.col("status") == "parsed").select(
        "name", "email", "phone", "skills", visa.alias("visa_status"), "yoe",
        F.col("path").alias("resume_path"), F.col("text").alias("resume_text"),
    )
