"""Print the physical operator trees of the key jobs (no data is collected).

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from sigsight.operators import ingest as I  # noqa: E402
from sigsight.operators import retrieval as R  # noqa: E402
from sigsight.plans import catalog  # noqa: E402
from sigsight.session import get_spark  # noqa: E402


def tree(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    keep = []
    for line in plan.splitlines():
        head = line.split("[")[0].split("(")[0].rstrip()
        if head.strip(" +-:*"):
            keep.append(head[:140])
    return "\n".join(keep)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sig, services = catalog._services(spark, sf)
    q = catalog.resolved_questions(spark, sf, sig, services)
    plans = {
        "hybrid_search": R.hybrid_search(q, sig),
        "ingest dedup + anti-join": I.anti_existing(
            I.dedup_first_wins(I.prepare(I.validate(catalog.raw_batch(spark, sf))[0])),
            catalog._stored(spark, sf)),
        "correlation_groups": catalog.correlation_groups(spark, sf),
        "latency_percentiles": catalog.latency_percentiles(spark, sf),
    }
    for name, df in plans.items():
        print(f"=== {name}")
        print(tree(df.select(*[F.col(c) for c in df.columns])))
        print()


if __name__ == "__main__":
    main()
