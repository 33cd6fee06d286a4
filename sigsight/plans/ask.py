"""The ask flow for a whole table of questions as one lazy plan.

questions → analytical gate (Q12) → rewrite (Q10) → window/service resolve
(Q4/Q8/Q11) → hybrid search top-20 (R7) → candidate stats (R8) → pair scores
(K2) → top-5 (K3) → stats + tier (K6/K7) → context + prompt (P10) → routed
answer (P11).  Every per-question step after the search partitions by
``qid``, so the plan has one shuffle for the top-k and reuses it.
"""

from __future__ import annotations

from functools import partial
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsight import config as C
from sigsight.functions.text import classify_query, normalize_query, rewrite_query
from sigsight.operators import context as P
from sigsight.operators import questions as Q
from sigsight.operators import rerank as K
from sigsight.operators import retrieval as R
from sigsight.session import cut_lineage, free_shuffles


def ask(q: DataFrame, events: DataFrame, services: DataFrame, answer_col: str | None = None,
        scorer: Callable[[Column, Column, Column], Column] | None = K.lexical_scorer,
        qid: str = "qid", materialize: bool = True,
        event_types_col: str | None = None,
        by_id: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Run the ask flow; returns ``results`` (one row per question), ``final`` hits and ``candidates``.

    ``materialize`` checkpoints the three small shared intermediates (resolved
    questions, the ≤20 candidates and the ≤5 final hits per question) to the
    session's shared checkpoint folder, so the search runs once although
    several branches (stats, tiers, context, answers) read its output.  Their
    size is bounded by the number of questions, not by the event table.

    The candidates go to the contents, are scored there, and go on without them (without a
    scorer contents are only read to tell equal events apart, if there are any):
    ``scored`` and ``ranked`` are the candidates and the final hits without contents,
    ``answers`` are the results without prompts.  ``contents`` adds the contents to rows
    of either (all columns kept); ``final`` and ``candidates`` are read through it.
    ``by_id`` gives the events of the ids in a table's first column and keeps its further
    columns, one row for each of the table's rows and its event (``sources.tables.signals``).
    """
    keep = cut_lineage if materialize else (lambda df: df)
    typed = q.withColumn("query_type", classify_query(F.col("question")))
    open_q = typed.where(F.col("query_type") != "analytical").withColumn(
        "rewritten_query", rewrite_query(F.col("question")))
    resolved = Q.resolve_request(open_q, services, window_mode="narrow")
    resolved = keep(resolved.withColumn("search_failed",
                                        ~R.valid_window(F.col("window_start"), F.col("window_end"))))
    # event_types_col: optional array<string> whitelist per question (empty or null = no filter).
    hits = R.hybrid_search(resolved, events, k=C.RERANK_TOP_K, qid=qid, event_types=event_types_col, payload=None)
    queries = resolved.select(qid, "rewritten_query", F.row_number().over(Window.partitionBy(qid).orderBy("rewritten_query")).alias("_copy"))
    asked = hits.join(queries, qid)

    def meet(content: bool) -> DataFrame:
        pairs = R.hit_payload(asked, events, by_id, content)
        return keep(K.score_pairs(pairs, "rewritten_query", scorer).drop("content", "rewritten_query"))
    with_content = scorer is not None or not materialize
    met = meet(with_content)
    # Without repeated questions or events every hit met its one event.
    repeated = not materialize or not met.where("_turn > 1 or _copy > 1").isEmpty() or met.count() > hits.count()
    if repeated and not with_content:
        met = meet(True)
    if materialize:
        free_shuffles(q.sparkSession)
    cands = R.own_events(met, qid) if repeated else met
    stats = R.candidate_stats(resolved, cands, qid)
    final = keep(K.rerank_topk(cands, C.FINAL_TOP_K, qid))
    contents = partial(R.contents, events=events, with_hits=by_id, repeated=repeated)
    tiered = K.with_confidence(resolved, final, qid).join(stats, qid)
    tiered = tiered.withColumn("confidence", F.when(F.col("search_failed"), F.lit("unknown"))
                               .otherwise(F.col("confidence")))
    ctx = P.assemble_context(tiered, final, qid, contents=contents)
    llm = F.col(answer_col) if answer_col else F.lit("")
    answered = tiered.select(
        qid, "query_type", "rewritten_query", "window_start", "window_end", "service_filter",
        "n_candidates", "avg_similarity", F.coalesce("n_final", F.lit(0)).alias("n_final"),
        "avg_rerank", "confidence",
        P.route_answer(llm, F.col("n_final"), F.col("confidence"), F.col("search_failed")).alias("answer"),
        "search_failed",
    )
    prompted = answered.join(ctx, qid).withColumn(
        "prompt", F.when(F.col("search_failed"), F.lit("")).otherwise(F.col("prompt"))).drop("search_failed", "context")
    gated = typed.where(F.col("query_type") == "analytical").select(
        qid, "query_type", normalize_query(F.col("question")).alias("rewritten_query"),
        F.lit(None).cast("timestamp_ntz").alias("window_start"), F.lit(None).cast("timestamp_ntz").alias("window_end"),
        F.lit(None).cast("string").alias("service_filter"), F.lit(0).cast("long").alias("n_candidates"),
        F.lit(0.0).alias("avg_similarity"), F.lit(0).cast("long").alias("n_final"),
        F.lit(float("nan")).alias("avg_rerank"), F.lit("unknown").alias("confidence"),
        F.lit(C.ANALYTICAL_ANSWER).alias("answer"), F.lit("").alias("prompt"))
    # A repeated question has as many answers as results.
    answers = answered.drop("search_failed").join(tiered.select(qid), qid)
    return {"results": prompted.unionByName(gated), "answers": answers.unionByName(gated.drop("prompt")),
            "final": contents(final).drop(*R.HELD), "candidates": contents(cands).join(queries, [qid, "_copy"]).drop(*R.HELD, "rerank_score"),
            "ranked": final, "scored": cands, "contents": contents}
