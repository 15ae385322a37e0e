"""Headline queries of the engine on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line: seconds by query, and rows a second."""

import json
import os
import statistics
import time

import pyarrow.dataset as ds
from pyspark.sql import SparkSession

from lumenlake.plans.catalog import all_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
WARM = int(os.environ.get("BENCH_RUNS", "3"))
#: Samples that a row of the table stands for: rasters have 64 pixels a row, in three channels where they are blended.
SAMPLES = {"preview_downsample": 64, "blend_u8": 192, "blend_float": 192, "label_boundary": 64, "roi_polygon": 64, "roi_long_outline": 64, "gaussian_feather": 64, "edge_distance": 64, "mask_objects": 64, "watershed_objects": 64, "pyramid_viewport": 192}
#: query: the table whose rows it reads
HEADLINE = {
    "cell_quantify": "lineitem",
    "cell_quantify_region": "lineitem",
    "phenotype_counts": "lineitem",
    "threshold_otsu": "lineitem",
    "threshold_p75": "lineitem",
    "intensity_ratio": "lineitem",
    "roi_stats_raw": "lineitem",
    "group_stats": "lineitem",
    "hist80_nonzero": "lineitem",
    "relabel_dense": "lineitem",
    "neighbours_radius": "embeddings",
    "knn_batched": "embeddings",
    "preview_downsample": "embeddings",
    "blend_u8": "embeddings",
    "blend_float": "embeddings",
    "label_boundary": "embeddings",
    "roi_polygon": "embeddings",
    "roi_long_outline": "embeddings",
    "edge_distance": "embeddings",
    "mask_objects": "embeddings",
    "watershed_objects": "embeddings",
    "pyramid_viewport": "embeddings",
    "curve_radius": "embeddings",
    "gaussian_feather": "embeddings",
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    for name, table in HEADLINE.items():
        build, took = all_queries()[name].build, []
        for _ in range(WARM + 1):
            began = time.perf_counter()
            build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
        rows = ds.dataset(f"{SF_DIR}/{table}.parquet").count_rows()
        rates[name] = round(rows * SAMPLES.get(name, 1) / seconds[name])
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "rows_per_sec": rates, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
