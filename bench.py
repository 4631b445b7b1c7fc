"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs once
to warm up and is then timed; results go to the no-op sink, so every row and
column is computed and nothing is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from levelcast.plans import catalog  # noqa: E402
from levelcast.session import build_session  # noqa: E402

HEADLINE = (
    "telemetry_hourly",
    "telemetry_daily",
    "missed_checkins",
    "fleet_snapshot",
    "daily_water_consumption",
    "out_of_order_arrivals",
    "gap_breaks",
    "window_checksum",
    "classify_messages",
    "dedupe_first_arrival",
    "arrival_out_of_order",
    "ingest_counters",
    "segment_split",
    "cadence",
    "theil_sen_slope",
    "forecast_detail",
    "attention_needed",
    "alert_decisions",
)


def timed(run, spark, directory):
    start = time.perf_counter()
    run(spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "levelcast-bench",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        timed(queries[name], spark, directory)
        seconds[name] = round(timed(queries[name], spark, directory), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
