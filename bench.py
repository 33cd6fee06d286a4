"""Headline-query benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is fully materialised with the ``noop`` sink (every column is
computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sigsight.plans import catalog  # noqa: E402
from sigsight.session import get_spark  # noqa: E402

HEADLINE = [
    "hybrid_search",
    "ask_answers",
    "assemble_context",
    "eval_summary",
    "ingest_counts",
    "normalise_log",
    "parse_questions",
    "parse_judge",
    "quality_summary",
    "correlation_groups",
    "events_before",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="sigsight-bench", shuffle_partitions=cpus * 2,
                      extra={"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # JVM warm-up only (class loading); no query work is cached by it.
    spark.range(1000).selectExpr("sum(id)").collect()
    # With BENCH_WARM=1 each query runs twice: as it first runs, and warm.  Nothing is cached in between.
    first, warm = {}, {}
    for name in names:
        for times in (first, warm) if os.environ.get("BENCH_WARM") == "1" else (first,):
            t0 = time.time()
            catalog.REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
            print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(first.values()), 3), "unit": "sec",
                      "queries": first, **({"warm": warm, "warm_value": round(sum(warm.values()), 3)} if warm else {}), "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
