"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from stratalake.plans.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["sand_in_box", "cum_thickness", "layer_top", "layer_top_thick", "layer_top_frac", "select_all", "slice_depth", "near_lines", "within_polygon", "spatial_join_left", "voxel_most_common", "voxel_boundary_join", "nearest_voxel_join", "validate_drop", "grain_percentiles"]


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
    run = lambda name: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    run("sand_in_box")  # warm-up
    took, spread = {}, {}
    for name in NAMES:
        times = []
        for _ in range(3):
            begin = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - begin)
        took[name], spread[name] = round(min(times), 3), round(max(times) - min(times), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "spread": spread, "sf": SF.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
