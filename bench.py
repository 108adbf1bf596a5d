"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query is planned and run to the end into
a sink that keeps nothing; the sum of their seconds is the metric.
"""

from __future__ import annotations

import json
import os
import time

from cityloom.plans import load
from cityloom.runtime import session

HEADLINE = [
    "a1_bin_points", "r4_fill_nearest", "q1_elevation_cache", "j1_points_in_polygons", "j4_overlap_join", "j5_line_support", "j6_roof_owner",
    "r2_rasterize", "r1_label_regions", "r9_canopy_relief", "r10_absorb_thin", "r16_building_heights", "q2_vector_cache", "q3_road_symbols", "q4_material_fields",
    "q5_cut_surface_and_seams", "q6_print_report", "q7_crossing_validation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    register = load().QUERIES
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        register[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    points = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline queries, total time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
        "cpus": int(cpus), "points": points, "points_per_sec_q1": round(points / seconds["q1_elevation_cache"], 1)}))


if __name__ == "__main__":
    main()
