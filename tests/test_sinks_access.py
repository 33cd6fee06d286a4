"""Sinks (S5–S8), access patterns (D1–D4) and the shuffle path of the range join."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from sigsight import config as C
from sigsight.operators import access as D
from sigsight.operators import retrieval as R
from sigsight.plans import catalog
from sigsight.sources import sinks as S
from sigsight.sources import tables as T


def test_query_log_feedback_report_sinks(spark):
    root = tempfile.mkdtemp(prefix="sig-sinks-")
    logs = T.query_logs(spark, SF_SMALL)
    S.append_query_log(logs, os.path.join(root, "ql"))
    S.append_query_log(logs, os.path.join(root, "ql"))
    assert spark.read.parquet(os.path.join(root, "ql")).count() == 2 * logs.count()
    fb = spark.createDataFrame([(1, "q", "a", "good", None), (2, "q", "a", "bad", "x"), (3, "q", "a", "meh", None)],
                               "id long, query string, answer string, rating string, comment string")
    rejected = S.append_feedback(fb, os.path.join(root, "fb"))
    assert rejected.count() == 1 and spark.read.parquet(os.path.join(root, "fb")).count() == 2
    res = spark.createDataFrame([("q1", "lookup", "scored")], "id string, category string, status string")
    S.write_report(res, res.groupBy("category").count(), res.agg(F.count("*").alias("total")),
                   os.path.join(root, "report"), eval_set="set.jsonl", timestamp_utc="2024-01-01T00:00:00+00:00")
    assert spark.read.json(os.path.join(root, "report", "aggregates")).first().total == 1
    meta = spark.read.json(os.path.join(root, "report", "run_metadata")).first()
    assert (meta.eval_set, meta.total_questions, meta.timestamp_utc) == ("set.jsonl", 1, "2024-01-01T00:00:00+00:00")


def test_access_patterns(spark):
    sig = T.signals(spark, SF_SMALL).drop("embedding")
    rows = sig.select("event_id", "occurred_at", "service", "event_type", "correlation_id").collect()
    at = sorted(r.occurred_at for r in rows)[len(rows) // 2]
    got = [r.event_id for r in D.events_before(sig, at, 600).collect()]
    want = sorted([r for r in rows if at - dt.timedelta(minutes=600) <= r.occurred_at <= at],
                  key=lambda r: (-r.occurred_at.timestamp(), r.event_id))
    assert got == [r.event_id for r in want]
    svc = rows[0].service
    tl = D.service_timeline(sig, svc).collect()
    assert all(r.service == svc for r in tl) and len(tl) == sum(r.service == svc for r in rows)
    lo, hi = min(r.occurred_at for r in rows), max(r.occurred_at for r in rows)
    assert D.deployments_in_window(sig, lo, hi).count() == sum(r.event_type == "deployment" for r in rows)
    cid = rows[0].correlation_id
    assert D.correlation_thread(sig, cid).count() == sum(r.correlation_id == cid for r in rows)
    groups = {r.correlation_id: r.n_events for r in D.correlation_groups(sig).collect()}
    assert sum(groups.values()) == len(rows)


def test_event_type_whitelist(spark):
    sig, services = catalog._services(spark, SF_SMALL)
    q = catalog.resolved_questions(spark, SF_SMALL, sig, services).withColumn(
        "types", F.array(F.lit("alert"), F.lit("deployment")))
    hits = R.hybrid_search(q, sig, event_types="types").select("event_type").distinct().collect()
    assert {r.event_type for r in hits} <= {"alert", "deployment"}
    assert C.RERANK_TOP_K == 20


def test_ask_with_event_type_whitelist(spark):
    from sigsight.plans.ask import ask

    sig, services = catalog._services(spark, SF_SMALL)
    q = T.questions(spark, SF_SMALL).withColumn("types", F.array(F.lit("deployment")))
    out = ask(q, sig, services, answer_col="llm_answer", event_types_col="types", materialize=False)
    types = {r.event_type for r in out["final"].select("event_type").distinct().collect()}
    assert types <= {"deployment"}
    empty = T.questions(spark, SF_SMALL).withColumn("types", F.array().cast("array<string>"))
    out2 = ask(empty, sig, services, answer_col="llm_answer", event_types_col="types", materialize=False)
    base = ask(T.questions(spark, SF_SMALL), sig, services, answer_col="llm_answer", materialize=False)
    assert out2["final"].count() == base["final"].count()  # an empty whitelist means no filter
