"""The access patterns the stored table is indexed for.

With events written partitioned by ``event_date`` and sorted by
``(service, occurred_at desc)`` inside files (``sinks.append_events``), the
time bounds prune date partitions and row groups, and the service/type
equalities are pushed to the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigsight.operators.range_counts import count_in_ranges, timeline

#: Timeline positions of a block.
BLOCK = 64


def _date_bounds(start: Column, end: Column) -> Column:
    return F.col("event_date").between(F.to_date(start), F.to_date(end))


def events_before(events: DataFrame, instant, minutes: int) -> DataFrame:
    """Events in the ``minutes`` before ``instant`` (closed range), newest first."""
    t = F.lit(instant) if not isinstance(instant, Column) else instant
    start = F.timestamp_add("MINUTE", F.lit(-minutes), t)
    return (events.where(_date_bounds(start, t) & F.col("occurred_at").between(start, t))
                  .orderBy(F.col("occurred_at").desc(), F.col("event_id")))


def event_timeline(events: DataFrame, position: str = "position") -> DataFrame:
    """All events with their 1-based position, oldest first; read backwards, equal times are in the order of event ids."""
    return timeline(events, [F.col("occurred_at"), F.col("event_id").desc()], position=position)


def events_before_runs(anchors: DataFrame, events: DataFrame, minutes: int, key: str = "qid", at: str = "asked_at") -> DataFrame:
    """D1 for a table of instants, run-length: (key, n, first_position, last_position), one row an instant with events.

    An instant's events are those positions of the ``event_timeline``, so the
    output grows with the instants and not with the events near them.
    """
    a = anchors.select(F.col(key), F.col(at).alias("_at"), F.timestamp_add("MINUTE", F.lit(-minutes), F.col(at)).alias("_from"))
    found = count_in_ranges(events, a, key, "_from", "_at")
    return found.select(key, "n", (F.col("first") + 1).alias("first_position"), (F.col("first") + F.col("n")).alias("last_position"))


def events_before_each(anchors: DataFrame, events: DataFrame, minutes: int, key: str = "qid",
                       at: str = "asked_at") -> DataFrame:
    """D1 for a table of instants, each event listed: (key, event rows, position), newest first within each instant.

    The runs are cut at blocks of ``BLOCK`` timeline positions, which meet the blocks'
    events: a run sends a row a block, and the work is the output.
    """
    runs = events_before_runs(anchors, events, minutes, key, at)
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    wanted = runs.select(key, "first_position", "last_position", F.explode(F.sequence(block("first_position"), block("last_position"))).alias("_block"))
    placed = event_timeline(events, "_place").withColumn("_block", block("_place"))
    # Both sides by a fixed number and merged: sizes before the explosion would broadcast what comes out of it, and
    # put the joined rows, which are many times the shuffled ones, into too few tasks.
    spark = events.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = placed.repartition(tasks, "_block").join(wanted.repartition(tasks, "_block").hint("merge"), "_block")
    return met.where(F.col("_place").between(F.col("first_position"), F.col("last_position"))) \
        .withColumn("position", (F.col("last_position") - F.col("_place") + 1).cast("int")).select(key, *events.columns, "position")


def service_timeline(events: DataFrame, service: str | None = None) -> DataFrame:
    """Service timelines, newest first by ``position`` within each whole service."""
    ev = events.where(F.col("service") == service) if service else events
    return timeline(ev, [F.col("occurred_at").desc(), F.col("event_id")], ["service"])


def count_in_windows(events: DataFrame, windows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """D3 for a table of windows: (key, n, last_at) over the events inside each closed window that has some."""
    return count_in_ranges(events, windows, key, start, end).select(key, "n", "last_at")


def deployments_in_window(events: DataFrame, start, end, event_type: str = "deployment") -> DataFrame:
    """D3: one event type inside a closed window."""
    s, e = F.lit(start), F.lit(end)
    return events.where((F.col("event_type") == event_type) & _date_bounds(s, e)
                        & F.col("occurred_at").between(s, e))


def correlation_thread(events: DataFrame, correlation_id: str) -> DataFrame:
    """All events of one correlation group, oldest first."""
    return events.where(F.col("correlation_id") == correlation_id).orderBy("occurred_at", "event_id")


def correlation_groups(events: DataFrame) -> DataFrame:
    """D4 summary for every group: size, span and services (partial aggregation; skew-safe)."""
    return (events.where(F.col("correlation_id").isNotNull()).groupBy("correlation_id")
                  .agg(F.count(F.lit(1)).alias("n_events"), F.min("occurred_at").alias("first_at"),
                       F.max("occurred_at").alias("last_at"),
                       F.count_distinct("service").alias("n_services")))
