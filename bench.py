"""Times the headline queries, the median of three runs each, and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanloom.plans.catalog import ENTRIES  # noqa: E402
from spanloom.session import build_session  # noqa: E402

HEADLINE = [
    "token_usage_hourly",
    "cost_cube",
    "cost_summary",
    "tool_performance_daily",
    "tool_transitions",
    "error_patterns_daily",
    "merged_error_patterns",
    "traces_archive",
    "trace_documents",
    "trace_statistics_daily",
    "trace_anomalies",
    "paired_spans",
    "dashboard_metrics",
    "latency_series",
    "agent_metrics",
    "metric_query",
    "period_comparison",
    "windowed_anomalies",
    "zscore_outliers",
    "deduplicated_alerts",
    "fired_rules",
    "region_health",
    "investigation_context",
    "similar_incidents",
    "searched_traces",
    "trace_lookup",
    "redacted_documents",
    "scrubbed_documents",
    "streamed_anomalies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ENTRIES["token_usage_hourly"].run(spark, sf_dir).limit(1).count()  # start the JVM side once
    took: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_REPEATS", "3"))):
            start = time.perf_counter()
            ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
