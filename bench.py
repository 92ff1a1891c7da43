"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every result is computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from simplexspark import get_session  # noqa: E402
from simplexspark.plans.registry import ALL  # noqa: E402

HEADLINE = [
    "monthly_coordinates", "monthly_panel", "daily_means", "merged_conflicts", "column_profile", "coordinate_summary",
    "box_statistics_strata", "variation_matrix", "clr_components", "aitchison_distance", "row_ids", "exact_split",
    "autocorrelation", "points_in_outline", "nearest_places", "lattice_covariates", "covariate_frame", "variogram_bins",
    "fixed_effects", "outlier_screen",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm the JVM
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.perf_counter()
        ALL[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
