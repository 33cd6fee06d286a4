"""Investigation counts, key signals, sectioned chronological context, prompt text.

Everything is computed per question over its ≤5 final hits with window
functions and one ``groupBy(qid)``; the groups are bounded by the final
top-k, and the grouping key is the partitioning key of the previous steps,
so no new shuffle is introduced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsight import config as C
from sigsight.functions.text import truncate_words
from sigsight.functions.timefmt import py_float4, utc_second


def severity_rank(severity: Column) -> Column:
    """CRITICAL 0, ERROR 1, WARNING 2, INFO 3, anything else 99 (case-insensitive)."""
    s = F.upper(severity)
    out = F.lit(99)
    for name, rank in reversed(list(C.SEVERITY_RANK.items())):
        out = F.when(s == name, F.lit(rank)).otherwise(out)
    return out


def is_high_severity(severity: Column) -> Column:
    return F.coalesce(F.upper(F.nullif(severity, F.lit(""))).isin(C.HIGH_SEVERITIES), F.lit(False))


def investigation_counts(final: DataFrame, qid: str = "qid") -> DataFrame:
    """Events, errors (ERROR/CRITICAL any case), deployments per question."""
    return final.groupBy(qid).agg(
        F.count(F.lit(1)).alias("timeline_events"),
        F.count_if(is_high_severity(F.col("severity"))).alias("error_events"),
        F.count_if(F.col("event_type") == "deployment").alias("deployment_events"),
    )


def _key_places(final: DataFrame, qid: str) -> DataFrame:
    """``key_order`` of the hits that may be key signals; reads no contents."""
    high = is_high_severity(F.col("severity"))
    by_q = Window.partitionBy(qid)
    sev_w = Window.partitionBy(qid).orderBy(
        F.when(high, F.lit(0)).otherwise(F.lit(1)), severity_rank(F.col("severity")), F.col("rank"))
    sem_w = Window.partitionBy(qid).orderBy(F.col("similarity_score").desc_nulls_last(), F.col("rank"))
    tagged = (final.withColumn("_high", high)
              .withColumn("_any_high", F.max(F.col("_high").cast("int")).over(by_q) == 1)
              .withColumn("_sev_pos", F.row_number().over(sev_w))
              .withColumn("_sem_pos", F.row_number().over(sem_w)))
    in_sev = F.col("_high") & (F.col("_sev_pos") <= 2)
    top_match = (F.col("_sem_pos") == 1) & ~in_sev
    order = F.when(~F.col("_any_high"), F.lit(None).cast("int")).when(in_sev, F.col("_sev_pos")).when(top_match, F.lit(3))
    return tagged.withColumn("key_order", order).drop("_high", "_any_high", "_sev_pos", "_sem_pos")


def _key_lines(placed: DataFrame) -> DataFrame:
    """``key_line`` of the rows of ``_key_places``; without a line there is no order."""
    tail = F.concat(F.col("service"), F.lit(" @ "), utc_second(F.col("occurred_at")), F.lit(": "),
                    F.substring(F.col("content"), 1, 120))
    line = (F.when(F.col("key_order") <= 2, F.concat(F.lit("- ["), F.upper(F.col("severity")), F.lit("] "), tail))
            .when(F.col("key_order") == 3, F.concat(F.lit("- [TOP MATCH] "), tail)))
    return placed.withColumn("key_line", line).withColumn("key_order", F.when(F.col("key_line").isNotNull(), F.col("key_order")))


def key_signals(final: DataFrame, qid: str = "qid", contents: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """P3 + P4: per hit, its key-signal order and line (null when it is not a key signal).

    Top two high-severity hits by (severity rank, hit rank), then the best
    similarity hit (first in hit order) as TOP MATCH unless already listed;
    nothing at all when the question has no high-severity hit.  ``contents`` adds the
    contents to hits that come without, after everything is placed.
    """
    placed = _key_places(final, qid)
    return _key_lines(contents(placed) if contents else placed)


def _section_places(final: DataFrame, qid: str) -> DataFrame:
    """P5 + P6 + P9: a row per (hit, section), its number there and its hit's ``_budget``; reads no contents."""
    high = is_high_severity(F.col("severity"))
    deploy = F.coalesce(F.col("event_type") == "deployment", F.lit(False))
    secs = F.array_compact(F.array(F.when(high, F.lit(0)), F.when(deploy, F.lit(1)),
                                   F.when(~high & ~deploy, F.lit(2))))
    n = F.count(F.lit(1)).over(Window.partitionBy(qid))
    budget = F.greatest(F.lit(C.MIN_CHARS_PER_EVENT), F.floor(F.lit(C.MAX_CONTEXT_CHARS) / n).cast("int"))
    ex = final.withColumn("_budget", budget).select("*", F.posexplode(secs).alias("_first", "section"))
    num_w = Window.partitionBy(qid, "section").orderBy(F.col("occurred_at"), F.col("rank"))
    return ex.withColumn("_first", F.col("_first") == 0).withColumn("section_pos", F.row_number().over(num_w))


def _section_blocks(placed: DataFrame) -> DataFrame:
    """P7 + P8: the ``block`` of the rows of ``_section_places``."""
    label = F.element_at(F.array(*[F.lit(lbl) for _, lbl in C.SECTIONS]), (F.col("section") + 1).cast("int"))
    score = F.coalesce(F.col("rerank_score"), F.col("similarity_score"))
    sev = F.when(F.coalesce(F.col("severity") != "", F.lit(False)),
                 F.concat(F.lit(" | "), F.upper(F.col("severity")))).otherwise(F.lit(""))
    header = F.concat(F.lit("["), label, F.lit(" "), F.col("section_pos").cast("string"), F.lit(" | "),
                      utc_second(F.col("occurred_at")), F.lit(" | "), F.col("service"), F.lit(" | "),
                      F.col("event_type"), sev, F.lit(" | score: "), py_float4(score), F.lit("]"))
    block = F.concat(header, F.lit("\n"), truncate_words(F.col("content"), F.col("_budget")))
    return placed.withColumn("block", block).drop("_budget")  # _first marks a hit's first section row


def section_events(final: DataFrame, qid: str = "qid", contents: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """P5 + P6 + P7 + P8 + P9: one row per (hit, section) with its numbered, budgeted block.

    Errors (CRITICAL/ERROR), Deployments (event_type) and Timeline (the rest);
    an error-severity deployment appears in both of the first two sections.
    ``contents`` adds the contents to hits that come without, after everything is placed.
    """
    placed = _section_places(final, qid)
    return _section_blocks(contents(placed) if contents else placed)


def _in_section(idx: int):
    # One-parameter lambda: PySpark reads a second parameter as the element index.
    return lambda b: b["section"] == idx


def assemble_context(q: DataFrame, final: DataFrame, qid: str = "qid", query_col: str = "rewritten_query",
                     confidence_col: str = "confidence", contents: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """P10: (qid, context, prompt) for every question of ``q``; fixed text when it has no hits.

    ``contents`` adds the contents to hits that come without: what moves on are lines and blocks.
    """
    placed = _section_places(_key_places(final, qid), qid)
    blocks = _section_blocks(_key_lines(contents(placed) if contents else placed))
    per_q = blocks.groupBy(qid).agg(
        F.array_sort(F.collect_list(F.struct("section", "section_pos", "block"))).alias("_blocks"),
        F.array_sort(F.collect_list(F.when(F.col("_first") & F.col("key_line").isNotNull(),
                                           F.struct("key_order", "key_line")))).alias("_keys"),
        F.count_if(F.col("_first")).alias("_n"),
    )
    parts = []
    for idx, (heading, _) in enumerate(C.SECTIONS):
        sel = F.transform(F.filter(F.col("_blocks"), _in_section(idx)), lambda b: b["block"])
        parts.append(F.when(F.size(sel) > 0, F.concat(F.lit(heading + "\n\n"), F.array_join(sel, "\n\n"))))
    context_section = F.concat_ws("\n\n", *parts)
    key_lines = F.transform(F.col("_keys"), lambda k: k["key_line"])
    key_block = F.when(F.size(key_lines) > 0, F.concat(F.lit("### Key Signals\n"), F.array_join(key_lines, "\n")))
    j = q.join(per_q, qid, "left")
    header = F.concat(F.lit("[Signal context: "), F.col("_n").cast("string"), F.lit(" event(s) | confidence: "),
                      F.col(confidence_col), F.lit("]"))
    context = F.when(F.col("_n").isNull(), F.lit(C.EMPTY_CONTEXT)).otherwise(
        F.concat_ws("\n\n", header, key_block, context_section))
    prompt = F.concat(F.lit(C.PROMPT_HEAD), context, F.lit(C.PROMPT_TAIL), F.col(query_col), F.lit(C.PROMPT_END))
    return j.select(qid, context.alias("context"), prompt.alias("prompt"))


def route_answer(answer: Column, n_hits: Column, confidence: Column, failed: Column | None = None) -> Column:
    """Search failure / no hits → fixed texts; low confidence → caveat prefix; else the answer."""
    out = (F.when(F.coalesce(n_hits, F.lit(0)) == 0, F.lit(C.NO_DATA_ANSWER))
           .when(confidence == "low", F.concat(F.lit(C.LOW_CONFIDENCE_PREFIX), answer))
           .otherwise(answer))
    if failed is not None:
        out = F.when(F.coalesce(failed, F.lit(False)), F.lit(C.SEARCH_FAILED_ANSWER)).otherwise(out)
    return out


SOURCE_FIELDS = ["id", "event_id", "content", "occurred_at", "service", "event_type", "similarity_score",
                 "severity", "rerank_score", "metadata"]


def sources_array(final: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, sources) with the 10 source fields per hit, in rank order."""
    agg = final.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", *SOURCE_FIELDS))).alias("_s"))
    return agg.select(qid, F.transform("_s", lambda s: s.dropFields("rank")).alias("sources"))
