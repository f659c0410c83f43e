"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs whole and its rows are written nowhere; times include planning.
"""

from __future__ import annotations

import json
import os
import time

from trailgrid.session import build_session
from workload.registry import QUERIES

HEADLINE = (
    "win_1", "join_6", "join_10", "join_1", "join_3", "txt_3", "flt_2", "geo_3", "join_14", "join_20",
    "win_5", "agg_15", "plan_4", "join_19", "agg_4", "str_1", "str_1_stream", "txt_12", "win_16", "plan_2",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        app="bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/part.parquet").groupBy("p_type").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
