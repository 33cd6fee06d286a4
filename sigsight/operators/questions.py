"""Q6–Q12: service registry, service extraction, parse, overrides, analytical gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsight import config as C
from sigsight.functions.text import classify_query, normalize_query
from sigsight.functions.windows import time_window_narrow, time_window_wide
from sigsight.operators.name_matching import first_names
from sigsight.operators.ranking import ranked_within
from sigsight.session import cut_lineage


def registry_from_events(events: DataFrame) -> DataFrame:
    """Q6: (service, ord) — distinct services, ``ord`` sorting them by name; the static list when there are none.

    A dimension of any size that stays distributed; the distinct combines
    map-side, so a service holding a third of all rows is one row per task.
    """
    live = cut_lineage(events.where(F.col("service").isNotNull()).select("service").distinct()
                       .select("service", F.col("service").alias("ord")))
    if not live.isEmpty():
        return live
    return events.sparkSession.createDataFrame(
        [(s, f"{i:04d}") for i, s in enumerate(C.STATIC_SERVICES)], "service string, ord string")


def service_registry(events: DataFrame) -> DataFrame:
    """Q6 with 1-based positions: (service, ord)."""
    # The sort keys are distinct, so counting the smaller ones is the position.
    return ranked_within(registry_from_events(events), "ord").select("service", F.col("_rank").cast("int").alias("ord"))


def extract_services(q: DataFrame, registry: DataFrame, question_col: str = "question",
                     key: str = "qid") -> DataFrame:
    """Q7 + Q8: (key, service_norm, service_raw) of the questions that name a service.

    Q7: the first registry service whose lower-cased hyphen-free form occurs in
    the normalised question; Q8: the first whose lower-cased form, with or
    without hyphens, occurs in the lower-cased raw question.  All names are
    matched in one pass over a text by an Aho-Corasick automaton
    (``name_matching``), so a text's length and the number of names add up and
    only questions that name a service leave the scan.
    """
    low = F.lower(F.col("service"))
    plain = F.replace(low, F.lit("-"), F.lit(" "))
    forms = registry.select("service", "ord", F.explode(F.array(
        *[F.struct(F.lit(kind).alias("kind"), form.alias("form")) for kind, form in
          (("norm", plain), ("raw", low), ("raw", plain))])).alias("f")).select("service", "ord", "f.*")
    forms = forms.where("form is not null").groupBy("kind", "form").agg(F.min(F.struct("ord", "service")).alias("first"))
    texts = q.select(F.col(key).alias("_key"), normalize_query(F.col(question_col)).alias("norm"), F.lower(F.col(question_col)).alias("raw"))
    named = first_names(texts, forms.select("kind", "form", "first.ord", "first.service"))
    first = lambda kind: F.min(F.when(F.col(f"{kind}_ord").isNotNull(), F.struct(f"{kind}_ord", f"{kind}_service")))
    return named.groupBy(F.col("_key").alias(key)).agg(*[first(kind)[f"{kind}_service"].alias(f"service_{kind}") for kind in ("norm", "raw")])


def parse_questions(q: DataFrame, registry: DataFrame, question_col: str = "question",
                    asked_col: str = "asked_at", key: str = "qid") -> DataFrame:
    """Q9: normalised text, type, wide window and service as extra columns of ``q``."""
    w = time_window_wide(F.col(question_col), F.col(asked_col))
    found = extract_services(q, registry, question_col, key).select(key, F.col("service_norm").alias("parsed_service"))
    return q.select(
        "*",
        normalize_query(F.col(question_col)).alias("normalized_query"),
        classify_query(F.col(question_col)).alias("query_type"),
        w["start"].alias("wide_start"),
        w["end"].alias("wide_end"),
        w["defaulted"].alias("wide_defaulted"),
    ).join(found, key, "left")


def resolve_request(q: DataFrame, registry: DataFrame, question_col: str = "question",
                    asked_col: str = "asked_at", start_col: str | None = "start_time",
                    end_col: str | None = "end_time", service_col: str | None = None,
                    window_mode: str = "narrow", key: str = "qid") -> DataFrame:
    """Q11 (+Q4/Q8 for the ask path): explicit start/end/service win, parsed values fill gaps.

    An empty service string counts as absent.  ``window_mode='narrow'`` is what
    the ask endpoint resolves with; ``'wide'`` uses the wide rule table.
    """
    text, asked = F.col(question_col), F.col(asked_col)
    w = time_window_narrow(text, asked) if window_mode == "narrow" else time_window_wide(text, asked)
    start = F.coalesce(F.col(start_col), w["start"]) if start_col else w["start"]
    end = F.coalesce(F.col(end_col), w["end"]) if end_col else w["end"]
    explicit_svc = F.nullif(F.col(service_col), F.lit("")) if service_col else F.lit(None).cast("string")
    # The ask path resolves with the raw-text matcher and falls back to the
    # normalised one inside the pipeline, so both apply in that order.
    parsed = F.coalesce("service_raw", "service_norm") if window_mode == "narrow" else F.col("service_norm")
    return q.select(
        "*",
        start.alias("window_start"),
        end.alias("window_end"),
        w["defaulted"].alias("window_defaulted"),
        explicit_svc.alias("_explicit"),
    ).join(extract_services(q, registry, question_col, key), key, "left") \
        .withColumn("service_filter", F.coalesce(F.col("_explicit"), parsed)) \
        .drop("_explicit", "service_norm", "service_raw")


def analytical_gate(q: DataFrame, question_col: str = "question") -> tuple[DataFrame, DataFrame]:
    """Q12: split into (answerable, analytical) — analytical rows carry the fixed guidance answer."""
    typed = q.withColumn("query_type", classify_query(F.col(question_col)))
    gated = typed.where(F.col("query_type") == "analytical").select(
        "*",
        F.lit(C.ANALYTICAL_ANSWER).alias("answer"),
        normalize_query(F.col(question_col)).alias("rewritten_query"),
        F.lit("unknown").alias("confidence"),
    )
    return typed.where(F.col("query_type") != "analytical"), gated
