"""Seconds per query on one machine, as one JSON line.

Every registered query runs on the test tables in ``BENCH_SF_DIR``. The mart
reports read the stored mart, whose cost is ``store_mart``; ``flagship`` is the
first of them in one plan from the raw tables. Each query runs once to warm up
and is then timed to its end (all rows and columns computed, none kept).
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

import pyspark  # noqa: E402

from shopledger.config import AnalysisConfig  # noqa: E402
from shopledger.operators.order_mart import order_level_mart  # noqa: E402
from shopledger.plans.registry import QUERIES, flagship  # noqa: E402
from shopledger.session import local_session, scratch_folder  # noqa: E402
from shopledger.sources.sample_shop import sample_tables  # noqa: E402
from shopledger.sources.sinks import write_mart  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    """Best of the runs after one warm-up."""
    action()
    seconds = []
    for _ in range(RUNS):
        started = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - started)
    return round(min(seconds), 3)


def main() -> None:
    spark = local_session(CPUS, "shopledger-bench")
    times: dict[str, float] = {}

    def measure(name, action) -> None:
        if not ONLY or name in ONLY:
            times[name] = timed(action)
            print(name, times[name], file=sys.stderr, flush=True)

    for name, query in QUERIES.items():
        measure(name, lambda query=query: consume(query(spark, SF_DIR)))

    measure("flagship", lambda: consume(flagship(spark, SF_DIR)))
    mart = order_level_mart(sample_tables(spark, SF_DIR), AnalysisConfig())
    target = scratch_folder(spark) + "/mart"
    measure("store_mart", lambda: write_mart(mart, target))

    print(
        json.dumps(
            {
                "metric": "sum of warm query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "spark": pyspark.__version__,
                "cores": CPUS,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
