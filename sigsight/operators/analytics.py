"""A1–A5: quality summary over the query log and feedback tables.

One aggregate pass per table (the reference issues four scans); each pass is
a partial+final hash aggregate, so the result is a 1-row frame whatever the
table size.  The two 1-row frames are combined by a join on a constant key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight import config as C
from sigsight.functions.numeric import exact_mean, exact_mean_parts


def query_log_summary(logs: DataFrame) -> DataFrame:
    """A1–A3: total queries, mean latency (round 3, 0.0 when empty), low-groundedness count."""
    g = F.col("groundedness_score")
    units, n = exact_mean_parts(F.col("latency"), 6)
    agg = logs.agg(
        F.count(F.lit(1)).alias("total_queries"),
        units.alias("_u"), (n * 1000).alias("_n"),
        F.count_if(g.isNotNull() & (g < C.LOW_GROUNDEDNESS_THRESHOLD)).alias("low_groundedness_count"),
    )
    # Summed in whole microseconds, so the mean is rounded to 3 decimals exactly (0.0 when empty).
    return agg.select("total_queries",
                      F.coalesce(F.when(F.col("_n") > 0, exact_mean("_u", "_n", 3)), F.lit(0.0)).alias("avg_latency"),
                      "low_groundedness_count")


def bad_feedback_count(feedback: DataFrame) -> DataFrame:
    """A4: feedback rows rated ``bad``."""
    return feedback.agg(F.count_if(F.col("rating") == "bad").alias("bad_feedback_count"))


def quality_summary(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """A5: one row with the four numbers."""
    a = query_log_summary(logs).withColumn("_k", F.lit(1))
    b = bad_feedback_count(feedback).withColumn("_k", F.lit(1))
    return a.join(b, "_k").drop("_k")
