"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])  # for the workers


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from attnmaps.operators import agreement
    from attnmaps.plans import jobs
    from attnmaps.plans.q_filters import TEST
    from attnmaps.plans.q_jobs import SMALL
    from attnmaps.plans.registry import QUERIES
    from attnmaps.sources.fixtures import Inputs

    def heatmaps(s, d):
        return jobs.heatmaps(jobs.clean(Inputs(s, d).subs, TEST), TEST)

    def split_half(s, d):
        return agreement.split_half(jobs.clean(Inputs(s, d).subs, TEST), replace(SMALL, iterations=10))

    found = {"w1_heatmaps": heatmaps, "job1_split_half_10": split_half}
    found |= {n: QUERIES[n] for n in ("joi3_nearest_reference", "ras3_mean_map", "ras8_cumulative_maps", "win1_dedupe_first", "agg6_medians_all", "met5_spearman", "w2_ceiling_floor")}
    seconds = {}
    QUERIES["flt1_filter_catch"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    for name, query in found.items():
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
