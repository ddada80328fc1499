"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and timed on a second run, written to the
no-op sink so that all its rows are computed; its seconds go to the error stream
as it ends. Published rates are of simulation engines only, which
are not rebuilt here, so these seconds compare with earlier rounds.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from adlayer.plans import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["reaction_catalogue", "quantile_buckets_lineitem", "rescaled_rates", "upsert_by_sid", "first_match_pattern", "pair_counts", "vacancy_counts", "propensity_snapshot", "event_replay", "coverage_timeseries", "final_lattice", "categorical_draw", "trajectory_file", "lattice_file", "windowed_event_counts", "session_events"]


def timed(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        query = queries.QUERIES[name]
        timed(lambda: query(spark, SF_DIR))  # noqa: B023
        seconds[name] = round(timed(lambda: query(spark, SF_DIR)), 3)  # noqa: B023
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
