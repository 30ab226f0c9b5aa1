"""Times every report at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``build_<table>`` derives and publishes a table, ``fit_model`` fits the churn model;
later reports read what these wrote. Each report is run whole into a sink
that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from holdfast.plans import registry  # noqa: E402
from holdfast.sources import schemas  # noqa: E402
from holdfast.sources.tables import load  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        begin = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - begin, 3)

    for name in schemas.ALL:
        timed(f"build_{name}", lambda: getattr(load(spark, sf_dir), name))
    timed("fit_model", lambda: registry.churn_model(spark, sf_dir))
    wanted = sys.argv[1:] or list(registry.QUERIES)
    for key in wanted:
        query = registry.QUERIES[key]
        timed(key, lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
