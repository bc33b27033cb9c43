"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned from scratch and run to a sink that discards its rows, so the time is planning plus
computing every row. Sessions start cold, so one small query runs first and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from casewright.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "linux_auth_events",
    "windows_security_events",
    "ocsf_events",
    "rule_matches",
    "many_rule_matches",
    "mixed_ingest",
    "spray_findings",
    "busy_source_findings",
    "window_event_counts",
    "entity_sightings",
    "evidence_digests",
    "graph_edges",
    "timeline_steps",
    "baselines",
    "incident_novelty",
    "failed_logon_followups",
    "feed_indicators",
    "event_search_page",
    "document_mentions",
    "grounded_statements",
    "attribution_checks",
    "audit_verification",
    "incidents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("casewright-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["triage_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "events": events,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
