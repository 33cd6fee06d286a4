"""K1–K8: second-stage scoring of the ≤20 candidates per question, cut to 5, tiers.

All steps partition by question id, the same key the first-stage top-k
already shuffled on, so Spark reuses that partitioning (no extra exchange).

The reference scores pairs with an injected cross-encoder.  Here the scorer
is injectable too:

* a *column scorer* ``f(query_col, pair_text_col, cos_col) -> Column``;
  the default ``lexical_scorer`` is a deterministic
  stand-in (token overlap + similarity, on a logit-like scale) so the rest
  of the chain — ordering, gates, tiers — runs on data;
* a *batch scorer* ``f(queries: pd.Series, texts: pd.Series) -> np.ndarray``
  run by ``score_pairs_batched`` with ``mapInPandas`` (one call per Arrow
  batch, the model loaded once per Python worker) for real models.
"""

from __future__ import annotations

from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsight import config as C
from sigsight.functions.numeric import exact_mean, exact_mean_parts

# The plain ranges, part of the classes after them, are told without a look at a character's properties.
_TOKEN_SPLIT = r"[^a-z0-9\p{L}\p{N}]+"
# The ASCII of the same class becomes blanks; bytes of other characters stay as they are.
_BLANKED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_ASCII = bytes(range(128))
# Up to so many tokens are looked for one by one; more meet the set of the text's tokens.
_FEW_TOKENS = 24


def rerank_text(severity: Column, event_type: Column, content: Column) -> Column:
    """K1: ``[SEVERITY] content`` or ``[EVENT_TYPE] content`` when severity is empty."""
    tag = F.upper(F.coalesce(F.nullif(severity, F.lit("")), event_type))
    return F.concat(F.lit("["), tag, F.lit("] "), content)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(c), _TOKEN_SPLIT), ""))


def _blanked(text: bytes) -> bytes:
    """A text in UTF-8 with blanks for what ``_TOKEN_SPLIT`` takes out (letters and digits as Python's Unicode has them)."""
    if not text.isascii():
        for other in set(text.translate(None, _ASCII).decode(errors="replace")):
            if not other.isalnum():
                text = text.replace(other.encode(), b" ")
    return text.translate(_BLANKED)


def count_tokens(wanted: list[str], text: bytes) -> int:
    """How many of the distinct tokens are among those of the lower-cased text."""
    text, tokens = _blanked(text), {t.encode() for t in wanted}
    if len(tokens) > _FEW_TOKENS:
        return len(tokens.intersection(text.split()))
    text = b" " + text + b" "
    return sum(b" " + t + b" " in text for t in tokens)


def _found(tokens: pa.Array, texts: pa.Array) -> pa.Array:
    """``count_tokens`` of rows, null without tokens or text: splitting whole texts by the JVM's regular expressions takes longer."""
    pairs = zip(tokens.to_pylist(), texts.cast(pa.binary()), strict=True)
    return pa.array([count_tokens(wanted, text.as_py()) if wanted is not None and text.is_valid else None for wanted, text in pairs], pa.int32())


def lexical_scorer(query: Column, text: Column, cos: Column) -> Column:
    """Default stand-in scorer: 6·(share of query tokens found in the text) + 4·cos − 3, round 4."""
    q = _tokens(query)
    overlap = F.arrow_udf(_found, "int")(q, F.lower(text)) / F.greatest(F.size(q), F.lit(1))
    return F.round(overlap * 6.0 + F.coalesce(cos, F.lit(0.0)) * 4.0 - 3.0, 4)


def score_pairs(hits: DataFrame, query_col: str = "rewritten_query",
                scorer: Callable[[Column, Column, Column], Column] | None = lexical_scorer) -> DataFrame:
    """K2 (column scorer): adds ``rerank_score`` (null when no scorer is available)."""
    text = rerank_text(F.col("severity"), F.col("event_type"), F.col("content"))
    score = scorer(F.col(query_col), text, F.col("cos")) if scorer else F.lit(None).cast("double")
    return hits.withColumn("rerank_score", score)


def score_pairs_batched(hits: DataFrame, predict: Callable, query_col: str = "rewritten_query") -> DataFrame:
    """K2 (batch scorer): ``predict(queries, texts) -> scores`` once per Arrow batch, rounded to 4."""
    import numpy as np

    with_text = hits.withColumn("_pair_text", rerank_text(F.col("severity"), F.col("event_type"),
                                                          F.col("content")))
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType(with_text.schema.fields + [StructField("rerank_score", DoubleType())])

    def fn(batches):
        for pdf in batches:
            if len(pdf):
                raw = np.asarray(predict(pdf[query_col], pdf["_pair_text"]), dtype=float)
                pdf["rerank_score"] = np.round(raw, 4)
            else:
                pdf["rerank_score"] = []
            yield pdf

    return with_text.mapInPandas(fn, schema).drop("_pair_text")


def rerank_topk(scored: DataFrame, k: int = C.FINAL_TOP_K, qid: str = "qid") -> DataFrame:
    """K3 + K4: keep k per question by score desc (stable on similarity rank).

    With null scores (no scorer) the order degenerates to similarity order,
    which is exactly the fallback of keeping the first k candidates.
    """
    w = Window.partitionBy(qid).orderBy(F.col("rerank_score").desc_nulls_last(), F.col("sim_rank"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def strong_weak(final: DataFrame) -> DataFrame:
    """K8: strong when there is no score or the score is above the threshold."""
    return final.withColumn("strong", F.col("rerank_score").isNull() | (F.col("rerank_score") > C.RERANK_THRESHOLD))


def rerank_stats(final: DataFrame, qid: str = "qid") -> DataFrame:
    """K5 + K6: per question count, avg/min/max score (round 4; NaN when no score), below-threshold flag."""
    nan = F.lit(float("nan"))
    s = F.col("rerank_score")
    agg = final.groupBy(qid).agg(
        F.count(F.lit(1)).alias("n_final"),
        F.count(s).alias("n_scored"),
        exact_mean_parts(s, 4)[0].alias("_u"), F.min(s).alias("_min"), F.max(s).alias("_max"),
        F.bool_and(F.coalesce(s <= C.RERANK_THRESHOLD, F.lit(False))).alias("all_below_threshold"),
    )
    return agg.select(
        qid, "n_final", "n_scored",
        F.when(F.col("n_scored") > 0, exact_mean("_u", "n_scored", 4)).otherwise(nan).alias("avg_rerank"),
        F.when(F.col("n_scored") > 0, F.round("_min", 4)).otherwise(nan).alias("min_rerank"),
        F.when(F.col("n_scored") > 0, F.round("_max", 4)).otherwise(nan).alias("max_rerank"),
        (F.col("all_below_threshold") & (F.col("n_scored") == F.col("n_final"))).alias("all_below_threshold"),
    )


def confidence_tier(n_final: Column, n_scored: Column, avg_rerank: Column) -> Column:
    """K7: none / unknown / high / medium / low (first match wins)."""
    n = F.coalesce(n_final, F.lit(0))
    return (F.when(n == 0, F.lit("none"))
            .when(F.coalesce(n_scored, F.lit(0)) == 0, F.lit("unknown"))
            .when(avg_rerank > -1.0, F.lit("high"))
            .when((avg_rerank > -2.0) & (n >= 3), F.lit("medium"))
            .otherwise(F.lit("low")))


def with_confidence(q: DataFrame, final: DataFrame, qid: str = "qid") -> DataFrame:
    """Questions with their K6 stats and K7 tier (questions without hits get ``none``)."""
    st = rerank_stats(final, qid)
    j = q.join(st, qid, "left")
    return j.withColumn("confidence", confidence_tier(F.col("n_final"), F.col("n_scored"), F.col("avg_rerank")))
