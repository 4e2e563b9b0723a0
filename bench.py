"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of parquet tables, BENCH_CPUS the local cores;
arguments choose other queries ("all" for every one).
"""

import json
import os
import sys
import time

from graticule.plans import all_queries
from graticule.session import local_session

HEADLINE = [
    "region_stats", "hazard_stats", "layer_profile", "stack_features", "corr_matrix",
    "minmax_scale", "spatial_split", "erode_borders", "balance_by_region", "sample_n",
    "balanced_batches", "patch_extract", "terrain_slope", "nearest_distance", "rasterize_count",
    "buffer_count", "multi_hazard_index", "heatwave_index", "fire_weather", "yearly_mean",
    "model_comparison", "auroc", "morans_i", "flow_accumulation", "fill_depressions",
    "knn_features", "fit_lr",
]


def run(spark, name, fn, folder):
    start = time.time()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    queries = all_queries()
    if names == ["all"]:
        names = list(queries)
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8)
    run(spark, "warm-up", queries["region_stats"], folder)
    times = {}
    for name in names:
        times[name] = run(spark, name, queries[name], folder)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
