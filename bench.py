"""Time the headline queries; prints one JSON line.

`BENCH_SF_DIR` names the tables (default /root/testdata/sf0.1) and `BENCH_CPUS`
the cores.  Every query runs to completion once, after small untimed runs of the
write paths that warm the JVM up and one that writes the store that reads share.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventloom.registry.queries import queries  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))

HEADLINE = [
    "accepted_summary",
    "ingest_single",
    "ingest_batch",
    "ingest_store",
    "rejects",
    "validate_events",
    "decode_wire",
    "publish_wire",
    "store_events",
    "stream_consume",
    "stream_dedup",
    "tenant_resolve",
    "quota_fixed_window",
    "quota_anchored_window",
    "stream_quota",
    "props_backfill",
    "events_page",
    "event_by_id",
    "events_slice",
    "cascade_delete",
    "funnel",
    "session_summary",
    "cart_state",
    "revenue",
    "event_mix",
    "latency_histogram",
    "throughput",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("eventloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("ingest_store", "ingest_batch", "stream_consume"):
            run(registered[name], spark, small)

    run(registered["event_mix"], spark, SF_DIR)  # writes the store that the reads below share
    seconds = {name: run(registered[name], spark, SF_DIR) for name in HEADLINE}
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR,
                "events": events,
                "events_per_second": {
                    name: round(events / seconds[name])
                    for name in ("ingest_single", "ingest_batch", "ingest_store", "stream_consume", "decode_wire")
                },
            }
        )
    )
    spark.stop()


def run(query, spark: SparkSession, folder: str) -> float:
    started = time.time()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 3)


if __name__ == "__main__":
    main()
