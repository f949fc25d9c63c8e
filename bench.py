"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its figure is the median.  Nothing is cached between runs: results
go to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from skein.plans import clicks, probes, tpch
from skein.session import local

RUNS = 3
MORE = ["win_row_number", "grouping_sets", "cube", "pivot_sum", "distinct_on", "agg_count_distinct", "exists_neq", "corr_scalar_subquery", "sort_multi", "join_full", "intersect", "json_value", "hamming_filter", "stream_tumbling"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local(cpus, int(cpus), os.environ.get("BENCH_MEMORY", "8g"), **{"spark.sql.files.openCostInBytes": "1m", "spark.sql.files.maxPartitionBytes": "16m"})
    times = {}
    for name in [*tpch.QUERIES, *clicks.QUERIES, *MORE]:
        taken = []
        for run in range(RUNS + 1):
            began = time.perf_counter()
            probes.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 4)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
