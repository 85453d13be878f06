"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the cores.
Each query runs twice in one session; the faster run counts, so that start-up
of the JVM is not part of it. Results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

import registered

HEADLINE = [
    "s1_read_tracks", "s3_read_features", "s6_write_features", "s7_write_grid", "m1_profile_features",
    "m3_time_resolution", "f1_select_time_range", "f2_select_time_cond", "f4_clip_tracks_timerange", "f5_filter_bbox",
    "f6_filter_polygon", "f6_filter_polygon_buffered", "f7_select_spatial", "f7_select_spatial_rows",
    "j1_merge_tracks_ref", "j1_merge_tracks_ref_shuffled", "j2_points_in_polygons", "j3_reindex_like", "a1_dissolve", "a1_dissolve_polygons", "g2_buffer_polygons",
    "a2_envelope", "a3_convex_hull", "a3_convex_hull_by_animal", "a5_groupby_multi_time",
    "a5_groupby_multi_time_spread", "a6_groupby_poly_time", "a6_groupby_poly_time_rows", "a6_groupby_poly_overlap",
    "a7_spatial_mean_series", "a8_coarsen_space", "a9_resample_down", "a10_track_density", "a12_first_day_exceeded",
    "i1_resample_up", "i2_resample_irregular", "i3_thin_all", "i4_regrid_nearest", "i5_interpolate",
    "g3_clip_lines_box", "g3_clip_lines_polygons", "g3_clip_polygons_zones", "g3_clip_polygons_overlap", "g4_reproject", "c1_subset_all_tracks_box",
    "c1_subset_all_tracks_hull", "c1_subset_mask", "c1_subset_mask_buffer_clip", "c2_explore_grid", "c3_prepare_tracks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("trackgrid-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for key in keys:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            registered.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[key] = round(min(runs), 3)
        print(key, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "runs": 2,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
