"""Time the registered queries. Prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is run once on a
warm session and its whole result is produced (no-op sink).
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from basketline.plans.queries import QUERIES  # noqa: E402

#: All registered queries of the library; those of the corpus operators are timed by their own check.
HEADLINE = tuple(QUERIES)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        # The tables are a few megabytes, so partitions may stay small to keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # One file is one scan task; shuffled joins spread the work that follows over the cores.
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("country_metrics")
    for name in HEADLINE:
        times[name] = round(run(name), 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
