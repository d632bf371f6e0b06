"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "grid_max", "grid_idw", "diff_raster", "debias", "descriptive_stats", "zonal_each", "stable_minus_foi", "slope", "hillshade", "fill_nearest",
    "variogram_single", "variogram_mean", "variogram_band", "bootstrap_median", "fit_model", "unc_brute", "unc_total", "unc_closed_form", "catalog_parse", "survey_workflow",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from terrane.plans.catalogue import QUERIES
    from terrane.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the second finds code compiled and files cached
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, better of two runs, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
