"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "tile_score_count", "big_tile_score", "ensemble_mosaic", "ensemble_blocks", "mosaic_mix", "border_suppressed_mosaic", "normalize_patch",
    "robust_scale", "score_python_model", "assign_first_area", "boundary_gaps", "gap_polygon_areas", "rasterize_crowns", "density_fixed",
    "density_knn", "label_frames", "segmentation_metrics", "components", "remove_small", "report_by_model", "count_regression",
    "smooth_labels_2d", "resample_bilinear", "training_batches_augmented", "two_resolution_batches", "upscaled_score_count", "kfold", "pair_siblings", "skip_done",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from gridlake.queries import QUERIES
    from gridlake.session import local_session

    spark = local_session(cpus, int(cpus), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start the JVM's threads before timing
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
