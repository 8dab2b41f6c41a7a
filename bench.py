"""Time the registered queries and print one line of JSON.

Every query is run once to warm up, then in up to BENCH_RUNS measured rounds
over all queries; the median counts.  A further round is begun only while it
fits into the budget, so the whole takes little more than that.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_RUNS     measured rounds at most (default 3)
BENCH_BUDGET   seconds for everything (default 420)
BENCH_QUERIES  comma-separated names (default: all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from stallwise import registry
from stallwise.session import build_session


def run(query, spark, folder: str) -> float:
    """Seconds to build and fully evaluate a query; rows are made and thrown away."""
    began = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    rounds = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "420"))
    queries = registry.queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(queries)
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    for name in names:
        run(queries[name], spark, folder)
    measured: dict[str, list[float]] = {name: [] for name in names}
    done, last = 0, 0.0
    while done < rounds and (done == 0 or time.perf_counter() - began + last < budget):
        start = time.perf_counter()
        for name in names:
            measured[name].append(run(queries[name], spark, folder))
        done, last = done + 1, time.perf_counter() - start
        print(f"round {done}: {last:.1f} s", file=sys.stderr, flush=True)
    seconds = {name: round(statistics.median(times), 3) for name, times in measured.items()}
    result = {
        "metric": f"total of {len(seconds)} query times (median of {done})",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
        "cpus": int(cpus),
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
