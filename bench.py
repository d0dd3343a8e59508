"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each query runs once to
warm up on a small scale if one lies beside, then once in full: all rows go to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lattica.catalog import HEADLINES, QUERIES
from lattica.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, int(cores) if cores.isdigit() else 8)
    small = f"{os.path.dirname(sf_dir)}/sf0.001"
    seconds = {}
    for name in HEADLINES:
        try:
            QUERIES[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
        except Exception as error:  # noqa: BLE001  one failure must not hide the other figures
            print(f"{name}: {error}", file=sys.stderr)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
