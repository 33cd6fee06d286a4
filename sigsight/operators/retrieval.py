"""time/service/type filtered vector search, for one or many questions.

``hybrid_search`` runs one algorithm at every size, ``vector_search.search``:
bounded question blocks against narrow event scans.  Only the winners' keys
leave a scan; the per-question top-k is a ``row_number() <= k`` filter, which
Spark plans as a partial ``WindowGroupLimit`` before the shuffle on ``qid`` and
a final one after it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsight import config as C
from sigsight.functions.vectors import cosine_from_parts, dot, norm, similarity_score
from sigsight.functions.numeric import exact_mean, exact_mean_parts
from sigsight.operators.vector_search import meet, search

#: What kept hits hold besides their payload, to fetch their contents again.
HELD = ["_turn", "_row", "_copy"]
HIT_PAYLOAD = ["id", "event_id", "content", "occurred_at", "service", "event_type", "severity", "metadata"]


def valid_window(start: Column, end: Column) -> Column:
    """A search window is usable only when start < end (null bounds are not)."""
    return F.coalesce(start < end, F.lit(False))


def in_window(events: DataFrame, start, end) -> DataFrame:
    """R2: closed-closed time filter (pushed to the Parquet scan as two bounds)."""
    return events.where(F.col("occurred_at").between(start, end))


def service_filter(events: DataFrame, service: str | None) -> DataFrame:
    """Optional exact service filter; empty/None means no filter."""
    return events.where(F.col("service") == service) if service else events


def event_type_filter(events: DataFrame, event_types: list[str] | None) -> DataFrame:
    """Optional event_type whitelist; empty/None means no filter."""
    return events.where(F.col("event_type").isin(list(event_types))) if event_types else events


def with_similarity(events: DataFrame, qvec: list[float], vec_col: str = "embedding") -> DataFrame:
    """R5 for one query vector: ``cos`` (unrounded) and ``similarity_score`` (rounded 4)."""
    q = F.array(*[F.lit(float(x)) for x in qvec])
    cos = cosine_from_parts(dot(q, F.col(vec_col)), norm(q), norm(F.col(vec_col)))
    return events.withColumn("cos", cos).withColumn("similarity_score", similarity_score(F.col("cos")))


def vector_topk(events: DataFrame, qvec: list[float], k: int = C.RERANK_TOP_K,
                start=None, end=None, service: str | None = None,
                event_types: list[str] | None = None,
                by_id: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One question – the same search with a question table of one row; null bounds mean all times."""
    row = (0, [float(x) for x in qvec], start or dt.datetime(1, 1, 1), end or dt.datetime(9999, 12, 31), service, event_types)
    q = events.sparkSession.createDataFrame(
        [row], "qid long, qvec array<double>, window_start timestamp_ntz, window_end timestamp_ntz, service_filter string, "
               "types array<string>")
    return hybrid_search(q, events, k, event_types="types", by_id=by_id).drop("qid")


def hybrid_search(q: DataFrame, events: DataFrame, k: int = C.RERANK_TOP_K, qid: str = "qid",
                  qvec: str = "qvec", start: str = "window_start", end: str = "window_end",
                  service: str = "service_filter", event_types: str | None = None,
                  by_id: Callable[[DataFrame], DataFrame] | None = None, payload: list[str] | None = HIT_PAYLOAD) -> DataFrame:
    """Top-k events per question inside its window/service/type filter.

    Returns (qid, sim_rank, cos, similarity_score, *payload), at most k rows a
    question.  Questions with no candidate (or an invalid window) have no rows.
    ``by_id`` fetches the hits' events by their ids (see ``vector_search.search``);
    a payload of the events' ``KEYS`` alone fetches none, and after None ``hit_payload`` does so later.
    """
    return search(q, events, k, qid, qvec, start, end, service, event_types, payload, by_id)


def hit_payload(hits: DataFrame, events: DataFrame, with_hits: Callable[[DataFrame], DataFrame] | None = None,
                content: bool = True) -> DataFrame:
    """Hits of ``KEYS`` with the rest of ``HIT_PAYLOAD``, and ``_row``, the hash of the content, by which a hit's equal events are told.

    A hit whose event is there repeatedly has a row for each: ``own_events`` leaves one.
    Without ``content`` no content is read, and there is no ``_row``.
    """
    if not content:
        return meet(hits, events, [c for c in HIT_PAYLOAD if c != "content"], with_hits)
    return meet(hits, events, HIT_PAYLOAD, with_hits).withColumn("_row", F.xxhash64("content"))


def own_events(met: DataFrame, qid: str = "qid") -> DataFrame:
    """Of a hit's equal events (repeated keys) the one of its turn; a repeated question's copies (``_copy``) each have theirs."""
    row = [F.col("_row") if c == "content" else F.xxhash64(c) for c in HIT_PAYLOAD]
    seat = Window.partitionBy(qid, "sim_rank", "_copy").orderBy(*row)
    return met.withColumn("_seat", F.row_number().over(seat)).where(F.col("_seat") == F.col("_turn")).drop("_seat")


def contents(hits: DataFrame, events: DataFrame, with_hits: Callable[[DataFrame], DataFrame] | None = None,
             repeated: bool = True) -> DataFrame:
    """Hits that went through ``hit_payload`` with their contents again; ``repeated``: events may repeat their keys."""
    found = meet(hits, events, ["content"], with_hits)
    if "_row" in hits.columns:
        found = found.where(F.xxhash64("content") == F.col("_row"))
    return found.dropDuplicates(hits.columns) if repeated else found


def candidate_stats(q: DataFrame, hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Per question, candidate count and mean similarity (round 4; 0.0 when none)."""
    units, n = exact_mean_parts(F.col("similarity_score"), 4)
    agg = hits.groupBy(qid).agg(F.count(F.lit(1)).alias("n_candidates"), units.alias("_u"), n.alias("_n"))
    agg = agg.select(qid, "n_candidates", exact_mean("_u", "_n", 4).alias("avg_similarity"))
    return (q.select(qid).join(agg, qid, "left")
             .select(qid, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
                     F.coalesce("avg_similarity", F.lit(0.0)).alias("avg_similarity")))


def no_data_questions(q: DataFrame, hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Questions whose window/service filter left no event."""
    return q.join(hits.select(qid).distinct(), qid, "left_anti")
