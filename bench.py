"""Times headline queries in local mode and prints one JSON line.

Each query runs to a no-op sink (its whole result is produced, nothing is collected): once to warm
up, then ``BENCH_RUNS`` times (default 3); the median counts.  Streaming and sink queries, which
run eagerly, are measured once including their writes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalog  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "event_counts", "latency_stats", "tenant_metrics", "windowed_event_agg", "stream_window_counts", "top_event_types",
    "running_tenant_count", "ewma_baseline", "ewma_anomaly", "failed_login_streak", "degraded_intervals",
    "validate_events", "status_transition_audit", "idempotent_ingest", "first_per_key", "idempotency_ttl", "dlq_classify",
    "dlq_retry_plan", "key_version_scd2", "cdc_apply", "outbox_relay", "mask_sensitive", "encrypt_column",
    "vclock_compare", "resolve_dispatch", "resolve_field_merge", "resolve_all", "sync_apply", "consistency_report",
    "alert_threshold_for", "counter_rate", "histogram_quantile", "alarm_eval_periods", "tail_sample", "page_by_created",
]
EAGER = ["aggregation_job", "sink_upsert_latest", "sink_stream_agg", "stream_ewma", "stream_dedup"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in [*HEADLINE, *EAGER]:
        if only and name not in only:
            continue
        query = catalog.QUERIES[name]
        taken = []
        for i in range(1 if name in EAGER else runs + 1):
            start = time.perf_counter()
            run(query(spark, sf))
            taken.append(time.perf_counter() - start)
        times[name] = round(taken[0] if name in EAGER else statistics.median(taken[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
