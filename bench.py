"""Times every registered query at $BENCH_SF_DIR and prints one JSON line.

The three staged tables are built first and timed on their own keys; each query
then reads them the way a user's session would. Every query runs once to warm up
and is timed on a second run that computes all rows and columns and discards
them. BENCH_QUERIES (comma separated) restricts the set.
"""

from __future__ import annotations

import json
import os
import time

from dirstats.session import build_session
from dirstats.testbed import binding, registry


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        "dirstats-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        for table in (binding.parsed, binding.listings, binding.entities):
            run(table(spark, warm_dir))
    seconds = {
        "stage_parsed": timed(lambda: binding.parsed(spark, sf_dir)),
        "stage_listings": timed(lambda: binding.listings(spark, sf_dir)),
        "stage_entities": timed(lambda: binding.entities(spark, sf_dir)),
    }
    for name, query in registry.all_queries().items():
        if only and name not in only:
            continue
        run(query(spark, sf_dir))
        seconds[name] = timed(lambda query=query: run(query(spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "total wall time, staged tables plus all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
