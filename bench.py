"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "prepare_events",
    "engineer_features",
    "forward_asof",
    "training_matrix",
    "training_matrix_summary",
    "expand_stages",
    "termination_features",
    "first_hit_lock",
    "overwrite_business",
    "zero_day_lock",
    "collapse_predictions",
    "event_window_summary",
    "error_summary",
    "trajectory_diagnostics",
    "trajectory_summary",
    "zero_day_summary",
    "trajectory_manifest",
    "band_daily",
    "non_converged_windows",
    "nearest_centroid",
    "nearest_haversine",
    "nearest_in_box",
    "locate_in_cells",
    "interval_join",
    "date_gaps",
    "date_segments",
    "reconcile_labels",
    "fit_ridge",
    "fit_boosted_trees",
)


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from seasontide.plans import catalog

    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        # every row and column is computed; nothing is sent to Python
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
