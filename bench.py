"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` picks the tables, ``BENCH_CPUS`` the cores. Each query runs once
to warm up; the median of the next runs counts. Results go to a no-op sink, so
every row and column is computed. ``materialise`` builds the two stored tables
that most queries read; it is timed the same way and is part of the total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame

from venuegrid.session import local_session, work_path
from verification import bindings, catalog

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "city_rank", "market_summary", "price_band_share", "rating_by_price", "high_votes_low_ratings",
    "city_currency_cost", "city_currency_location", "currency_price_band", "top_labels", "label_rating",
    "top3_labels_per_city", "label_currency_join", "city_label_pivot", "service_comparison",
    "iqr_fences_by_group", "cost_outliers", "describe_percentiles", "column_profile", "exact_duplicate_rows",
    "cost_percentile", "cost_category", "clean", "spearman", "welch_t", "kruskal",
    "label_opportunities", "label_opportunities_sql", "spatial_clusters", "slice_listings", "option_lists", "write_quality_report", "write_chart_tables",
]


def force(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = local_session(CPUS, shuffle_partitions=int(CPUS), app="venuegrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    bindings.listing_tables(spark, FOLDER)
    rebuilt = [timed(lambda: bindings.build_tables(spark, FOLDER, work_path(spark, "tables"))) for _ in range(RUNS)]
    seconds = {"materialise": statistics.median(rebuilt)}
    queries = catalog.queries()
    for name in names:
        force(queries[name](spark, FOLDER))
        runs = [timed(lambda: force(queries[name](spark, FOLDER))) for _ in range(RUNS)]
        seconds[name] = statistics.median(runs)
    result = {
        "metric": "headline_queries_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(FOLDER.rstrip("/")),
        "cpus": CPUS,
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
