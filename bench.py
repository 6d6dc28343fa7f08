"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line. Each query is written out whole once to warm up at the smallest size, then timed three times; the
median counts. `load` is the machine's load average before and after, so that a busy machine shows."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from filmspark.plans import catalog

HEADLINE = ["render_plan", "xfade_offsets", "chunk_ranges_custom", "stitch_plan", "shot_view", "adjacent_score", "detect_shots", "representative_frame", "reuse_references", "stale_outputs", "log_counters", "milestone_progress"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(d.rstrip("/")), "sf0.001")
    took, load = {}, [os.getloadavg()[0]]
    for name in HEADLINE:
        if os.path.isdir(small):
            catalog.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(3):
            began = time.time()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    load.append(os.getloadavg()[0])
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"), "load": [round(x, 1) for x in load]}))
    spark.stop()


if __name__ == "__main__":
    main()
