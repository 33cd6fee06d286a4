"""S3/S4 readers, the batched scorer path (K2) and an injected encoder."""

import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sigsight.operators import ingest as I
from sigsight.operators import rerank as K
from sigsight.plans import catalog
from sigsight.plans.ask import ask
from sigsight.sources import tables as T
from sigsight.sources.bundle import read_questions, read_signal_bundle


def test_bundle_with_null_lists(spark):
    d = tempfile.mkdtemp(prefix="sig-null-")
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump({"logs": None, "events": [{"service": "api-gateway", "occurred_at": "2026-04-10T08:00:00Z",
                                             "content": "deploy"}]}, f)
    raw, bad = read_signal_bundle(spark, d)
    assert [(r.source, r.pos) for r in raw.collect()] == [("events", 0)]
    assert bad.count() == 0


def test_truncated_bundle_is_rejected_not_lost(spark):
    d = tempfile.mkdtemp(prefix="sig-cut-")
    whole = json.dumps({"logs": [{"service": "a", "occurred_at": "2026-04-10T08:00:00Z", "content": "x"}], "events": [], "metadata": []})
    for name, text in (("good.json", whole), ("cut.json", whole[:60])):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    raw, bad = read_signal_bundle(spark, d)
    assert [r.content for r in raw.collect()] == ["x"]
    assert [r.raw for r in bad.collect()] == [whole[:60]]


def test_question_set_jsonl(spark):
    d = tempfile.mkdtemp(prefix="sig-qs-")
    rows = [{"id": "q1", "category": "lookup", "question": "What changed?", "ground_truth_event_ids": ["evt_abc"]},
            {"id": "q2", "category": "temporal", "question": "Between 10:00 and 10:05?",
             "start_time": "2026-03-15T10:00:00Z", "end_time": "2026-03-15T10:05:00Z",
             "ground_truth_event_ids": ["evt_1", "evt_2"], "_interval_note": "closed-closed"}]
    with open(os.path.join(d, "set.jsonl"), "w") as f:
        f.write(json.dumps(rows[0]) + "\n\n" + json.dumps(rows[1]) + "\n   \n" + '{"id": "q3", "question": \n')
    read, bad = read_questions(spark, d)
    assert [r.raw for r in bad.collect()] == ['{"id": "q3", "question": ']
    qs = read.orderBy("id").collect()
    assert [q.id for q in qs] == ["q1", "q2"]
    assert qs[1].start_time == "2026-03-15T10:00:00Z" and qs[0].start_time is None
    assert qs[1].ground_truth_event_ids == ["evt_1", "evt_2"]


def test_batched_scorer_matches_column_scorer_order(spark):
    sig, services = catalog._services(spark, SF_SMALL)
    out = ask(T.questions(spark, SF_SMALL), sig, services, answer_col="llm_answer", materialize=False)
    cands = out["candidates"]

    def predict(queries, texts):
        # A stand-in model: 10 x (share of query words present) - 5.
        res = []
        for q, t in zip(queries, texts):
            qw = set(q.lower().split())
            res.append(10.0 * len(qw & set(t.lower().split())) / max(len(qw), 1) - 5.0)
        return np.array(res)

    scored = K.score_pairs_batched(cands, predict)
    final = K.rerank_topk(scored).collect()
    assert final and all(r.rank <= 5 for r in final)
    assert all(r.rerank_score == round(r.rerank_score, 4) for r in final)
    per_q = {}
    for r in final:
        per_q.setdefault(r.qid, []).append((r.rank, r.rerank_score))
    for ranks in per_q.values():
        scores = [s for _, s in sorted(ranks)]
        assert scores == sorted(scores, reverse=True)


def test_injected_encoder(spark):
    raw = spark.createDataFrame(
        [("logs", 0, "svc", "2026-01-01T00:00:00Z", "ERROR pid=1 boom", None, None, None, None)],
        "source string, pos long, service string, occurred_at string, content string, event_type string, "
        "severity string, correlation_id string, metadata string")

    def encoder(texts):
        return np.array([[len(t), 0.0, 0.0] for t in texts])

    res = I.ingest(raw, None, encoder=encoder)
    row = res["new"].select("normalised", "embedding").first()
    assert row.normalised == "boom" and row.embedding == [1.0, 0.0, 0.0]
    assert res["new"].select(F.col("event_type")).first()[0] == "log"


def test_tokens_are_found_as_the_split_finds_them(spark):
    """The scorer counts the distinct tokens of a query that its text holds: any script, few tokens or many, null texts."""
    texts = ["Der Käse—ist „gut“, order_service: 12½ ok", "", None, "ΑΣ ΟΔΟΣ İstanbul 　東京、大阪 x\x00y z\x1fw", "a" * 50 + " b-c", "näive café", "bar foobar barfoo"]
    queries = ["gut KÄSE order service kase 12½ — _", "東京 大阪 y w x οδος", "bar foo", " ".join(f"w{i}" for i in range(60)) + " b c café y 大阪", None, "!!"]
    df = spark.createDataFrame([(q, t, 0.25) for q in queries for t in texts], "q string, t string, cos double")
    split = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(c), K._TOKEN_SPLIT)), "")
    want = F.round(F.size(F.array_intersect(split("q"), split("t"))) / F.greatest(F.size(split("q")), F.lit(1)) * 6.0 + F.col("cos") * 4.0 - 3.0, 4)
    rows = df.select("q", "t", want.alias("want"), K.lexical_scorer(F.col("q"), F.col("t"), F.col("cos")).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == [] and len({r.got for r in rows}) > 4
    assert K.count_tokens(["b", "foo"], b"a-b foobar") == 1
