"""Global ranks without a single-task window.

``Window.orderBy(x)`` with no partition moves every row into one task.  Here
rows are first counted by value, which combines map-side however often a value
repeats; the distinct values are range-partitioned, and a value's rank is the
running count within its partition plus the count of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsight.session import cut_lineage


def value_counts(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(*groups, value, _before, _count, _n): rows of the group below the value, of it, and of the group."""
    groups = groups or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_count"))
    # Checkpointed: both uses below must see the same partitions.
    counts = cut_lineage(counts.orderBy(*groups, value).withColumn("_pid", F.spark_partition_id()))
    per = counts.groupBy("_pid", *groups).agg(F.sum("_count").alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))) \
        .withColumn("_n", F.sum("_sum").over(Window.partitionBy(*groups)))
    same = [F.col("c._pid") == F.col("p._pid")] + [F.col(f"c.{g}").eqNullSafe(F.col(f"p.{g}")) for g in groups]
    joined = counts.alias("c").join(per.alias("p"), same)
    inside = Window.partitionBy("c._pid", *[f"c.{g}" for g in groups]).orderBy(F.col(f"c.{value}")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*[F.col(f"c.{c}") for c in (*groups, value)],
                         (F.col("_offset") + F.coalesce(F.sum("_count").over(inside), F.lit(0))).alias("_before"), "_count", "_n")


def ranked_within(df: DataFrame, value: str) -> DataFrame:
    """``df``, whose ``value`` is distinct, with its 1-based position ``_rank``."""
    return df.join(value_counts(df, value).select(value, (F.col("_before") + 1).alias("_rank")), value)
