"""Registry fallback on an empty table; a degenerate window becomes the fixed failure answer."""

import datetime as dt

from conftest import SF_SMALL
from sigsight import config as C
from sigsight.operators import questions as Q
from sigsight.plans import catalog
from sigsight.plans.ask import ask
from sigsight.sources import tables as T


def test_registry_static_fallback(spark):
    empty = T.signals(spark, SF_SMALL).limit(0)
    assert [r.service for r in Q.registry_from_events(empty).orderBy("ord").collect()] == C.STATIC_SERVICES
    reg = Q.service_registry(empty).orderBy("ord").collect()
    assert [r.service for r in reg] == C.STATIC_SERVICES


def test_midnight_today_window_fails_cleanly(spark):
    sig, services = catalog._services(spark, SF_SMALL)
    q = spark.createDataFrame(
        [(1, "why did payment-service fail today", dt.datetime(2024, 1, 15), None, None, [0.1] * 64, "llm"),
         (2, "why did payment-service fail yesterday", dt.datetime(2024, 1, 15), None, None, [0.1] * 64, "llm")],
        "qid long, question string, asked_at timestamp_ntz, start_time timestamp_ntz, end_time timestamp_ntz, "
        "qvec array<float>, llm_answer string")
    # The ask path uses the narrow table: "today" is not in it (1-hour default), so use the wide one here.
    wide = Q.resolve_request(q, services, window_mode="wide").collect()
    assert wide[0].window_start == wide[0].window_end
    out = {r.qid: r for r in ask(q, sig, services, answer_col="llm_answer", materialize=False)["results"].collect()}
    assert out[1].answer in (C.NO_DATA_ANSWER, "llm", C.LOW_CONFIDENCE_PREFIX + "llm")
    failed = q.withColumn("start_time", q.asked_at).withColumn("end_time", q.asked_at)
    res = {r.qid: r for r in ask(failed, sig, services, answer_col="llm_answer", materialize=False)["results"].collect()}
    assert res[1].answer == C.SEARCH_FAILED_ANSWER and res[1].confidence == "unknown" and res[1].prompt == ""


def test_registry_of_fifty_thousand_names(spark):
    from pyspark.sql import functions as F

    reg = spark.range(50_000).select(F.concat(F.lit("Svc-"), F.col("id").cast("string"), F.lit("-x")).alias("service"))
    reg = reg.withColumn("ord", F.col("service"))
    q = spark.createDataFrame([(1, "is svc 49999 x up?"), (2, "svc-7-x and svc-12-x"), (3, "svc-50000-x"), (4, ""), (5, "SVC-31-X!")],
                              "qid long, question string")
    got = {r.qid: (r.service_norm, r.service_raw) for r in Q.extract_services(q, reg).collect()}
    assert got == {1: ("Svc-49999-x",) * 2, 2: ("Svc-12-x",) * 2, 5: ("Svc-31-x",) * 2}
