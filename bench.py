"""Wall time of the headline queries, printed as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query writes
all its rows to a sink that discards them; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "insights_report", "funnel", "kpis", "kpi_comparison", "activity_trends_daily", "activity_heatmap", "top_pages",
    "top_events", "cta_leaderboard", "blueprint_treemap", "top_paths", "time_to_convert", "visitor_mix", "session_rows",
    "session_summary", "recent_converters", "canonical_events", "parse_envelope", "dedupe_events", "sessionize_gap",
    "sessionize_fixed", "live_stats", "rates", "event_counters", "top_components", "latency_histogram",
    "histogram_quantile", "latest_samples", "event_table_scan", "ingest_status", "offset_gaps", "stream_ingest",
    "stream_windows", "stream_latest_n",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="clickloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(min(runs), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "events": events,
        "report_events_per_sec": round(events / seconds["insights_report"]),
        "ingest_messages_per_sec": round(events * 1.02 / seconds["stream_ingest"]),
    }))


if __name__ == "__main__":
    main()
