"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from importlib.util import find_spec

from pyspark.sql import SparkSession

from terrastrata.plans import queries as plans

HEADLINE = [
    "quantiles_strata", "breaks_multi_map", "dist_population", "map_two_rasters", "poly_strata", "access_mask", "srs_basic", "srs_mindist", "strat_random_optim",
    "strat_queinnec", "systematic_hexagon_random", "pca_three_band", "clhs_samples",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.queries(), {}
    names = list(HEADLINE)
    if find_spec("terrastrata.llm") is not None:
        from terrastrata.llm import queries as llm

        queries |= llm.queries()
        names += [n for n in queries if n.startswith("op") or n == "pipeline"]
    queries["breaks_single"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warms the JVM up
    for name in names:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
