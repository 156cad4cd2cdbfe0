"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nodeloom.plans.catalog import QUERIES  # noqa: E402

HEADLINES = (
    "a3_total_degree",
    "a6_weighted_total_degree",
    "a7_degree_distribution",
    "b3_value_bins",
    "g1_pagerank",
    "g2_weighted_pagerank",
    "g6_triangle_counts",
    "g7_local_clustering",
    "g9_ego_nets",
    "g13_svd_embedding",
    "g14_combined_core",
    "g14_combined",
    "m5_covariance",
    "m6_gramian",
    "m7_column_cosines",
    "m9_qr_product",
    "m10_svd_product",
    "m12_multiply_local",
    "m16_multiply",
    "v1_dot",
    "v3_squared_distance",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("nodeloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINES
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in wanted:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
