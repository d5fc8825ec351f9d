"""Application event logs: typed records, JSON lines, slow operations, tails, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import columns

# The extra fields of each event kind, after ts, level, logger, msg, request_id.
EVENT_FIELDS = {
    "resume_parsed": ("candidate_id", "file_type", "skills_found", "yoe", "visa_status", "duration_ms", "success", "error"),
    "embedding_generated": ("entity_type", "entity_id", "dim", "duration_ms", "success"),
    "db_query": ("query_name", "duration_ms", "row_count", "slow", "error"),
    "prediction_made": ("model_name", "entity_type", "entity_id", "score", "duration_ms"),
}
SLOW_QUERY_MS = 500
SLOW_WORDS = ("slow", "took", "timeout")
LEVEL_RANK = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}

EVENT_SCHEMA = columns(
    ts="timestamp", level="string", logger="string", msg="string", request_id="string",
    event="string", duration_ms="double", success="boolean", error="string",
    candidate_id="long", file_type="string", skills_found="int", yoe="double",
    visa_status="string", entity_type="string", entity_id="long", dim="int",
    query_name="string", row_count="int", slow="boolean", model_name="string",
    score="double", exception="string",
)
CORRUPT = "_corrupt_record"
LINE_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])


def is_slow(duration_ms: Column) -> Column:
    return duration_ms > SLOW_QUERY_MS


def query_level(duration_ms: Column) -> Column:
    return F.when(is_slow(duration_ms), F.lit("WARNING")).otherwise(F.lit("DEBUG"))


def event_records(fields: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed event rows from raw fields and an event kind, after the columns to keep.

    Fields that do not belong to the kind become null, durations get two decimals,
    scores four, and queries their slow flag and level.
    """
    kind, took = F.col("event"), F.col("duration_ms")
    query = kind == "db_query"

    def belongs(name: str) -> Column:
        return kind.isin(*[k for k, extra in EVENT_FIELDS.items() if name in extra])

    values = {
        "level": F.when(query, query_level(took)).otherwise(F.lit("INFO")),
        "logger": F.lit("events"),
        "msg": kind,
        "duration_ms": F.round(took.cast("decimal(18,6)"), 2).cast("double"),
        "slow": F.when(query, is_slow(took)),
        "score": F.when(belongs("score"), F.round(F.col("score").cast("decimal(18,8)"), 4).cast("double")),
        "exception": F.lit(None).cast("string"),
    }
    out = []
    for f in EVENT_SCHEMA.fields:
        if f.name in values:
            value = values[f.name]
        elif f.name in ("ts", "request_id", "event"):
            value = F.col(f.name)
        else:
            value = F.when(belongs(f.name), F.col(f.name))
        out.append(value.cast(f.dataType).alias(f.name))
    return fields.select(*keep, *out)


def to_lines(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text per record, after the columns to keep."""
    return records.select(*keep, F.to_json(F.struct(*EVENT_SCHEMA.names)).alias("line"))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed records from JSON lines; a broken line becomes msg with level UNKNOWN."""
    record = F.from_json(
        F.col(line), LINE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    others = [c for c in lines.columns if c != line]
    rows = lines.select(*others, F.col(line).alias("_line"), record.alias("_r"))
    broken = F.col(f"_r.{CORRUPT}").isNotNull()
    values = {
        "msg": F.when(broken, F.trim("_line")).otherwise(F.col("_r.msg")),
        "level": F.when(broken, F.lit("UNKNOWN")).otherwise(F.col("_r.level")),
    }
    return rows.select(
        *others,
        *[
            values.get(f.name, F.when(~broken, F.col(f"_r.{f.name}"))).alias(f.name)
            for f in EVENT_SCHEMA.fields
        ],
    )


def tail(lines: DataFrame, order: tuple[str, ...], n: int = 100) -> DataFrame:
    """The last n lines in the given order, parsed; blank ones among them are dropped.

    The limit is the purpose; it runs as a per-partition top n with a small merge.
    """
    last = lines.orderBy(*[F.desc(c) for c in order]).limit(n)
    return parse_lines(last.where(F.trim("line") != ""))


def slow_queries(records: DataFrame) -> DataFrame:
    """Calls and slow calls per query name."""
    return (
        records.where(F.col("event") == "db_query")
        .groupBy("query_name")
        .agg(F.count("*").alias("calls"), F.count_if(F.col("slow")).alias("slow_calls"))
    )


def is_slow_operation(level: Column, msg: Column) -> Column:
    """Warning or worse, with a word of slowness in the message."""
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in LEVEL_RANK.items() for v in kv]), level)
    text = F.lower(msg)
    hit = F.lit(False)
    for word in SLOW_WORDS:
        hit = hit | text.contains(word)
    return (rank >= LEVEL_RANK["WARNING"]) & hit


def slow_operations(records: DataFrame) -> DataFrame:
    return records.where(is_slow_operation(F.col("level"), F.col("msg")))


def log_stats(lines: DataFrame) -> DataFrame:
    """Line count and size in KB (one decimal) per log; lines end with one byte."""
    size = F.sum(F.octet_length("line") + 1)
    return lines.groupBy("log").agg(
        F.round(size.cast("decimal(20,0)") / 1024, 1).cast("double").alias("size_kb"),
        F.count("*").alias("lines"),
    )
