"""Times the headline queries and prints one JSON line.

The first run of each is not counted, as it compiles code; the figure is the best of the rest.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402

from tablescope import profile  # noqa: E402
from tablescope.plans import catalogue  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = ("numeric_summary", "quantiles_lineitem", "n_distinct_lineitem", "numeric_histogram", "pearson_matrix", "text_lengths", "duplicate_rows_events", "logical_types_customer")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    jobs = {
        "profile_full_lineitem": lambda: profile(lineitem).to_dict(),
        "profile_minimal_lineitem": lambda: profile(lineitem, minimal=True).to_dict(),
        "profile_full_orders": lambda: profile(orders).to_dict(),
    }
    jobs |= {name: (lambda f=catalogue.QUERIES[name]: f(spark, SF_DIR).collect()) for name in HEADLINE}
    seconds = {}
    for name, job in jobs.items():
        best = None
        for run in range(RUNS + 1):
            began = time.perf_counter()
            job()
            took = time.perf_counter() - began
            if run and (best is None or took < best):
                best = took
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "full profile and headline queries, sum of best times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
