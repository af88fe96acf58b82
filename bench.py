"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: a warm-up, then the median of three runs of each."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "center_1_series_mean", "series_mean", "gramian", "cov", "zscore_0", "normalize_window_exact", "detrend_nonlinear", "fourier", "convolve_same",
    "crosscorr", "median_by_index", "times_matrix", "toseries", "toblocks_padded", "gaussian_filter", "localcorr", "dense_series_lineitem",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from voxelframe import catalogue

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, seconds = catalogue.queries(), {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            made[name](spark, d).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
    sf = float(os.path.basename(os.path.normpath(d)).removeprefix("sf") or 0)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
