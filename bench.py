"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM and the Python workers, then BENCH_RUNS times to a
sink that reads every row; the median counts. The fact tables (placements, payroll, timesheets) are grouped from order
lines and written once before any timing, as a warehouse would hold them; every query reads the written tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from talentmill.plans.queries import QUERIES
from talentmill.session import build_session, drop_intermediates
from talentmill.sources import star_views

HEADLINE = (
    "parse_documents", "extract_skills", "skill_frequency", "hash_embed",
    "monthly_revenue", "margin_leakage_fanout", "op_latency_stats", "weekly_hours",
    "placement_detail", "match_scores", "upsert_entities", "timesheet_findings",
    "stage_update", "cosine_topk", "cosine_neighbour_counts", "stream_event_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else None,
        extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-shared-"), "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g")},
    )
    spark.sparkContext.setLogLevel("OFF")
    for view in (star_views.placements, star_views.payroll, star_views.timesheets):
        view(spark, sf_dir)
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            drop_intermediates(spark, once=False)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    resumes = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "resumes_per_sec": round(resumes / seconds["parse_documents"], 1),
        "embeds_per_sec": round(resumes / seconds["hash_embed"], 1),
    }))
    drop_intermediates(spark)
    spark.stop()


if __name__ == "__main__":
    main()
