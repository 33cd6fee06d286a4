"""Search, rerank and context against plain-Python brute force on the smallest tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sigsight import config as C
from sigsight.operators import context as P
from sigsight.operators import retrieval as R
from sigsight.operators import questions as Q
from sigsight.operators import vector_search
from sigsight.plans import catalog
from sigsight.sources import tables as T


@pytest.fixture(scope="module")
def small(spark):
    sig, services = catalog._services(spark, SF_SMALL)
    q = catalog.resolved_questions(spark, SF_SMALL, sig, services)
    ev = sig.select("event_id", "occurred_at", "service", "embedding").collect()
    qs = q.select("qid", "qvec", "window_start", "window_end", "service_filter").collect()
    return sig, q, ev, qs


def _brute(ev, qs, k):
    out = {}
    for q in qs:
        if q.window_start is None or not q.window_start < q.window_end:
            continue
        qv = np.array(q.qvec, dtype=np.float64)
        cands = []
        for e in ev:
            if not (q.window_start <= e.occurred_at <= q.window_end):
                continue
            if q.service_filter and e.service != q.service_filter:
                continue
            v = np.array(e.embedding, dtype=np.float64)
            d = float(np.sqrt(qv @ qv) * np.sqrt(v @ v))
            cos = max(-1.0, min(1.0, float(sum(a * b for a, b in zip(qv, v))) / d)) if d > 0 else None
            cands.append((cos, e.event_id))
        cands.sort(key=lambda t: (t[0] is None, -(t[0] or 0.0), t[1]))
        if cands:
            out[q.qid] = [eid for _, eid in cands[:k]]
    return out


@pytest.mark.parametrize(("cell_events", "cell_questions", "winner_bytes"), [(8192, 4096, 1 << 26), (7, 4096, 0), (50, 3, 1 << 26)])
def test_hybrid_search_equals_brute_force(spark, small, monkeypatch, cell_events, cell_questions, winner_bytes):
    """Also with cells so small that dates fill many, and with winners that are not broadcast."""
    monkeypatch.setattr(vector_search, "CELL_EVENTS", cell_events)
    monkeypatch.setattr(vector_search, "CELL_QUESTIONS", cell_questions)
    monkeypatch.setattr(vector_search, "WINNER_BYTES", winner_bytes)
    sig, q, ev, qs = small
    hits = R.hybrid_search(q, sig, k=C.RERANK_TOP_K).select("qid", "sim_rank", "event_id").collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.sim_rank)):
        got.setdefault(h.qid, []).append(h.event_id)
    assert got == _brute(ev, qs, C.RERANK_TOP_K)


@pytest.mark.parametrize(("cell_events", "winner_bytes", "rounds"), [(8192, 1 << 26, 4), (40, 0, 16)])
def test_search_in_rounds_equals_brute_force(spark, small, monkeypatch, cell_events, winner_bytes, rounds):
    """A round holds a part of the events; later rounds give only what reaches a question's k-th best so far."""
    monkeypatch.setattr(vector_search, "CELL_EVENTS", cell_events)
    monkeypatch.setattr(vector_search, "WINNER_BYTES", winner_bytes)
    monkeypatch.setattr(vector_search, "ROUND_ROWS", 1)
    monkeypatch.setattr(vector_search, "ROUNDS", rounds)
    dealt, cells = [], vector_search._cells

    def counted(*frames):
        asked, events = cells(*frames)
        dealt.append((events.count(), asked.where("floor is not null").count()))
        return asked, events

    monkeypatch.setattr(vector_search, "_cells", counted)
    sig, q, ev, qs = small
    hits = R.hybrid_search(q, sig, k=5).select("qid", "sim_rank", "event_id").collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.sim_rank)):
        got.setdefault(h.qid, []).append(h.event_id)
    assert got == _brute(ev, qs, 5)
    assert rounds / 2 < len(dealt) <= rounds + 1 and max(n for n, _ in dealt) < 3 * len(ev) / rounds
    assert dealt[0][1] == 0 and all(floors for _, floors in dealt[len(dealt) // 2:])


EVENT = ("id long, event_id string, content string, occurred_at timestamp_ntz, service string, event_type string, "
         "severity string, metadata string, event_date date, embedding array<float>")
QUESTION = "qid long, qvec array<float>, window_start timestamp_ntz, window_end timestamp_ntz, service_filter string"


def _events(spark, vectors):
    """(event_id, id, vector) rows, all at one time."""
    import datetime as dt

    at = dt.datetime(2024, 1, 2, 3)
    return spark.createDataFrame([(i, e, f"text {i}", at, "cart", "log", None, None, at.date(), v) for e, i, v in vectors], EVENT)


def _ask(spark, *vectors):
    import datetime as dt

    return spark.createDataFrame([(n, v, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), "") for n, v in enumerate(vectors)], QUESTION)


def test_search_with_repeated_event_ids_keeps_k_rows(spark):
    ev = _events(spark, [("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("b", 3, [1.0, 0.1])])
    hits = R.hybrid_search(_ask(spark, [1.0, 0.0]), ev, k=3).orderBy("sim_rank").collect()
    assert [(h.sim_rank, h.event_id, h.id) for h in hits] == [(1, "a", 1), (2, "a", 2), (3, "a", 2)]


def test_search_ranks_null_uneven_and_zero_vectors_last(spark):
    ev = _events(spark, [("a", 1, None), ("b", 2, [1.0, 2.0, 3.0]), ("c", 3, [0.0, 1.0]), ("d", 4, [0.0, 0.0]), ("e", 5, [1.0])])
    hits = R.hybrid_search(_ask(spark, [1.0, 0.0], None, [0.5]), ev, k=4).orderBy("qid", "sim_rank").collect()
    got = [(h.qid, h.event_id, h.similarity_score) for h in hits]
    assert got[:4] == [(0, "c", 0.0), (0, "a", None), (0, "b", None), (0, "d", None)]
    assert got[4:8] == [(1, e, None) for e in "abcd"]
    assert got[8:] == [(2, "e", 1.0), (2, "a", None), (2, "b", None), (2, "c", None)]


def test_rounds_of_one_date_keep_ties_nulls_and_repeated_keys(spark, monkeypatch):
    """A date larger than a round goes in slices; ties, missing vectors and repeated rows are ranked over all of them."""
    same = [("t", 7, [0.0, 1.0])] * 3 + [(f"t{i:02d}", i, [0.0, 2.0]) for i in range(20, 40)]
    rows = same + [("n", 1, None), ("z", 2, [0.0, 0.0]), ("y", 4, [1.0, 2.0])]
    ev, q = _events(spark, rows), _ask(spark, [0.0, 1.0], [1.0, 0.0], None)
    q = q.unionByName(q.where("qid = 0"))
    find = lambda k: sorted(map(tuple, R.hybrid_search(q, ev, k=k, payload=["id", "event_id", "event_date", "content"])
                                .select("qid", "sim_rank", "event_id", "id", "similarity_score").collect()))
    want = [find(k) for k in (4, 9, 27)]
    monkeypatch.setattr(vector_search, "ROUND_ROWS", 1)
    monkeypatch.setattr(vector_search, "ROUNDS", 5)
    assert [find(k) for k in (4, 9, 27)] == want and len(want[1]) > 20


def test_contents_are_fetched_for_hits_only(spark, small, monkeypatch):
    """Winners too many to broadcast are told by id before the view joins its texts; keys need the texts' heads alone."""
    monkeypatch.setattr(vector_search, "WINNER_BYTES", 0)
    sig, q, _, _ = small
    asked = []

    def by_id(ids):
        asked.append(ids.count())
        return T.signals(spark, SF_SMALL, ids)

    cols = ["qid", "sim_rank", "event_id", "id", "content"]
    got = R.hybrid_search(q, sig, k=3, by_id=by_id).select(cols)
    assert sorted(got.collect()) == sorted(R.hybrid_search(q, sig, k=3).select(cols).collect())
    assert asked == [got.select("id").distinct().count()]
    plan = sig.select("event_id", "embedding")._jdf.queryExecution().optimizedPlan().toString()
    assert "Project [doc_id" in plan and not any("Project [doc_id" in line and ", text#" in line for line in plan.splitlines())


def test_hits_of_keys_alone_need_no_second_scan(spark, small):
    """The keys that a search holds are its result; no event or document is read again for them."""
    sig, q, _, _ = small
    cols = ["qid", "sim_rank", "event_id", "id", "event_date", "similarity_score"]
    got = R.hybrid_search(q, sig, k=5, payload=vector_search.KEYS).select(cols)
    assert sorted(got.collect()) == sorted(R.hybrid_search(q, sig, k=5, payload=[*vector_search.KEYS, "service"]).select(cols).collect())
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_cell_gives_k_rows_whatever_ties(spark):
    """Of rows that tie with the k-th best, the first by key (null keys before others) leave a cell."""
    import datetime as dt

    import pyarrow as pa

    at, n = dt.datetime(2024, 1, 2, 3), 500
    ids = [None if i == 77 else f"e{(i * 37) % n:03d}" for i in range(n)]
    vecs = [[0.0, 0.0] if i == 3 else [1.0, 0.0] if i < 490 else [1.0, 1.0] for i in range(n)]
    events = pa.table({"event_id": ids, "id": list(range(n)), "event_date": [at.date()] * n, "occurred_at": pa.array([at] * n, pa.timestamp("us")),
                       "service": ["cart"] * n, "event_type": ["log"] * n, "embedding": pa.array(vecs, pa.list_(pa.float32()))})
    asked = pa.table({"qid": [1, 2], "qvec": pa.array([[1.0, 0.1], [0.1, 1.0]], pa.list_(pa.float32())), "start": pa.array([at] * 2, pa.timestamp("us")),
                      "end": pa.array([at + dt.timedelta(hours=1)] * 2, pa.timestamp("us")), "service": pa.array([None, ""], pa.string()),
                      "types": pa.array([None, []], pa.list_(pa.string())), "dim": [2, 2]})
    got = vector_search._cell(20)(events, asked).to_pylist()
    ties = sorted((e for i, e in enumerate(ids) if i < 490 and i != 3), key=lambda e: (e is not None, e or ""))
    assert sorted((r["event_id"] for r in got if r["qid"] == 1), key=lambda e: (e is not None, e or "")) == ties[:20]
    second = {r["event_id"] for r in got if r["qid"] == 2}
    assert second == set(ids[490:]) | set(ties[:10]) and len(got) == 40


def test_search_of_windows_and_types_by_runs(spark):
    """Many questions with windows inside a cell, service and type filters, and rows without a similarity."""
    import datetime as dt
    import random

    rng, day = random.Random(5), dt.datetime(2024, 1, 2)
    rows = []
    for i in range(3000):
        at = day + dt.timedelta(seconds=rng.randrange(86_400))
        vec = rng.choice([None, [0.0, 0.0]]) if i % 50 == 0 else [rng.choice([-1.0, 0.5, 1.0]), rng.choice([-1.0, 0.25, 2.0])]
        rows.append((i, f"e{rng.randrange(10**6):06d}", "x", at, rng.choice("ab"), rng.choice(["log", "alert", "deployment"]), None, None, at.date(), vec))
    asked = []
    for n in range(300):
        start = day + dt.timedelta(seconds=rng.randrange(-3600, 86_400))
        asked.append((n, [rng.random(), rng.random()], start, start + dt.timedelta(seconds=rng.choice([60, 3600, 200_000])), rng.choice(["", "a"]),
                      rng.choice([None, [], ["log"], ["alert", "log"]])))
    q = spark.createDataFrame(asked, QUESTION + ", types array<string>")
    hits = R.hybrid_search(q, spark.createDataFrame(rows, EVENT), k=5, event_types="types").collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.sim_rank)):
        got.setdefault(h.qid, []).append(h.event_id)

    def cos(u, v):
        size = math.sqrt(u[0] * u[0] + u[1] * u[1]) * math.sqrt(v[0] * v[0] + v[1] * v[1]) if v else 0
        return max(-1.0, min(1.0, (0.0 + u[0] * v[0] + u[1] * v[1]) / size)) if size else -2.0

    want = {}
    for n, u, start, end, service, types in asked:
        mine = [r for r in rows if start <= r[3] <= end and service in ("", r[4]) and (not types or r[5] in types)]
        vec = lambda r: [float(np.float32(x)) for x in r[9]] if r[9] else None
        best = sorted(mine, key=lambda r: (-cos([float(np.float32(x)) for x in u], vec(r)), r[1], r[0]))[:5]
        if best:
            want[n] = [r[1] for r in best]
    assert got == want and len(want) > 200


def test_vector_topk_single_question(spark, small):
    from types import SimpleNamespace

    sig, q, ev, qs = small
    first = qs[0]
    top = R.vector_topk(sig, list(first.qvec), 5).orderBy("sim_rank").collect()
    whole = SimpleNamespace(qid=first.qid, qvec=first.qvec, window_start=min(e.occurred_at for e in ev),
                            window_end=max(e.occurred_at for e in ev), service_filter=None)
    brute = _brute(ev, [whole], 5)[first.qid]
    assert [t.event_id for t in top] == brute


HIT = ("qid long, rank int, id long, event_id string, content string, occurred_at timestamp_ntz, service string, "
       "event_type string, severity string, similarity_score double, rerank_score double, metadata string")


def _hit(rank, ident, minute, content, kind="log", severity=None, similarity=0.5, score=None, qid=1):
    import datetime as dt

    return (qid, rank, ident, f"e{ident}", content, dt.datetime(2024, 2, 3, 4, minute), "cart", kind, severity,
            similarity, score, None)


def _context(spark, hits, confidence="medium"):
    asked = spark.createDataFrame([(1, "why?", confidence)], "qid long, rewritten_query string, confidence string")
    row = P.assemble_context(asked, spark.createDataFrame(hits, HIT)).first()
    assert row.prompt == C.PROMPT_HEAD + row.context + "\n---\n\nQuestion: why?\n\nAnswer:"
    return row.context


def test_context_without_hits(spark):
    assert _context(spark, []) == "(No relevant incident events found in selected time window.)"


def test_context_of_quiet_events_is_one_timeline(spark):
    hits = [_hit(1, 7, 30, "second line", severity="info", similarity=0.25),
            _hit(2, 8, 10, "first line", severity="", score=-0.125)]
    assert _context(spark, hits, "low") == (
        "[Signal context: 2 event(s) | confidence: low]\n\n"
        "## Timeline\n\n"
        "[Event 1 | 2024-02-03T04:10:00Z | cart | log | score: -0.125]\nfirst line\n\n"
        "[Event 2 | 2024-02-03T04:30:00Z | cart | log | INFO | score: 0.25]\nsecond line")


def test_context_lists_an_error_deployment_in_both_sections(spark):
    assert _context(spark, [_hit(1, 7, 5, "rollout broke", "deployment", "error", 0.75, 1.5)], "high") == (
        "[Signal context: 1 event(s) | confidence: high]\n\n"
        "### Key Signals\n- [ERROR] cart @ 2024-02-03T04:05:00Z: rollout broke\n\n"
        "## Errors / Alerts\n\n"
        "[Error 1 | 2024-02-03T04:05:00Z | cart | deployment | ERROR | score: 1.5]\nrollout broke\n\n"
        "## Deployments / Changes\n\n"
        "[Deploy 1 | 2024-02-03T04:05:00Z | cart | deployment | ERROR | score: 1.5]\nrollout broke")


def test_context_key_signals_rank_severity_then_name_the_top_match(spark):
    hits = [_hit(1, 1, 1, "best match", similarity=0.9), _hit(2, 2, 2, "an error", severity="error", similarity=0.8),
            _hit(3, 3, 3, "critical one", severity="critical", similarity=0.1)]
    assert _context(spark, hits).split("\n\n")[1] == (
        "### Key Signals\n"
        "- [CRITICAL] cart @ 2024-02-03T04:03:00Z: critical one\n"
        "- [ERROR] cart @ 2024-02-03T04:02:00Z: an error\n"
        "- [TOP MATCH] cart @ 2024-02-03T04:01:00Z: best match")


def test_context_cuts_each_event_to_its_share(spark):
    hits = [_hit(i, i, i, "ab " * 400, similarity=0.5) for i in range(1, 6)]
    bodies = [block.split("\n")[-1] for block in _context(spark, hits).split("\n\n")[2:]]
    # 2000 characters for five events: 400 each, cut after the last whole word.
    assert bodies == ["ab " * 132 + "ab..."] * 5


def test_prompts_of_the_ask_flow_hold_its_hits(spark):
    from sigsight.plans.ask import ask

    sig, services = catalog._services(spark, SF_SMALL)
    out = ask(T.questions(spark, SF_SMALL), sig, services, answer_col="llm_answer")
    hits = {r.qid: r.n for r in out["final"].groupBy("qid").agg(F.count("*").alias("n")).collect()}
    asked = [r for r in out["results"].collect() if r.prompt]
    assert len(asked) > 10
    for r in asked:
        n = hits.get(r.qid, 0)
        assert (f"[Signal context: {n} event(s) | confidence: {r.confidence}]" in r.prompt) == (n > 0)


def test_contents_stay_where_candidates_are_scored(spark):
    """The flow goes on without contents, which are read again where needed; events that repeat their keys too."""
    import datetime as dt

    from sigsight.operators import rerank as K
    from sigsight.plans.ask import ask

    day, rows = dt.datetime(2024, 1, 2), []
    for i in range(60):
        at = day + dt.timedelta(minutes=i)
        sev = [None, "error", "info"][i % 3]
        rows.append((i % 50, f"e{i % 50:02d}", f"cart text {i} " + "timeout " * (i % 4), at, "cart-service", ["log", "deployment"][i % 2], sev, None,
                     at.date(), [1.0, float(i % 7)]))
    rows += [rows[4], rows[9][:2] + ("another text",) + rows[9][3:]]
    asked = spark.createDataFrame([(n, "timeout of cart-service in the last 2 hours", day + dt.timedelta(hours=1), None, None, [1.0, float(n)], "llm")
                                   for n in range(4)], "qid long, question string, asked_at timestamp_ntz, start_time timestamp_ntz, "
                                                       "end_time timestamp_ntz, qvec array<float>, llm string")
    services = spark.createDataFrame([("cart-service", "cart-service")], "service string, ord string")
    cols = ["qid", "rank", "sim_rank", "id", "event_id", "content", "severity", "rerank_score", "similarity_score"]
    for events in (spark.createDataFrame(rows, EVENT), spark.createDataFrame(rows[:50], EVENT)):
        out = ask(asked, events, services, answer_col="llm")
        assert "content" not in out["scored"].columns and "content" not in out["ranked"].columns
        resolved = Q.resolve_request(asked, services).select("*", F.col("question").alias("q"))
        pairs = R.hybrid_search(resolved, events, k=C.RERANK_TOP_K)
        rewritten = out["candidates"].select("qid", "rewritten_query").distinct()
        whole = K.rerank_topk(K.score_pairs(pairs.join(rewritten, "qid"), "rewritten_query"))
        assert sorted(out["final"].select(cols).collect(), key=str) == sorted(whole.select(cols).collect(), key=str)
        lines = ["qid", "rank", "section", "section_pos", "block"]
        assert sorted(P.section_events(out["ranked"], contents=out["contents"]).select(lines).collect()) == sorted(P.section_events(whole).select(lines).collect())
        keyed = ["qid", "rank", "key_order", "key_line"]
        assert sorted(P.key_signals(out["ranked"], contents=out["contents"]).select(keyed).collect(), key=str) == \
            sorted(P.key_signals(whole).select(keyed).collect(), key=str)
        answers = {r.qid: r.answer for r in out["answers"].collect()}
        assert answers == {r.qid: r.answer for r in out["results"].collect()} and len(answers) == 4


def test_route_answer(spark):
    df = spark.createDataFrame([("ans", 0, "none", False), ("ans", 3, "low", False), ("ans", 5, "high", False),
                                ("ans", 0, "unknown", True)], "a string, n int, c string, f boolean")
    got = [r[0] for r in df.select(P.route_answer(F.col("a"), F.col("n"), F.col("c"), F.col("f"))).collect()]
    assert got == [C.NO_DATA_ANSWER, C.LOW_CONFIDENCE_PREFIX + "ans", "ans", C.SEARCH_FAILED_ANSWER]


def test_confidence_tiers(spark):
    from sigsight.operators.rerank import confidence_tier
    rows = [(0, 0, math.nan), (5, 0, math.nan), (5, 5, -0.5), (3, 3, -1.5), (2, 2, -1.5), (5, 5, -0.99996)]
    df = spark.createDataFrame(rows, "n long, s long, a double")
    got = [r[0] for r in df.select(confidence_tier(F.col("n"), F.col("s"), F.round(F.col("a"), 4))).collect()]
    assert got == ["none", "unknown", "high", "medium", "low", "medium"]


def test_events_without_vectors_are_the_same_events(spark):
    """Readers of no vectors get the same events, and the vectors' ids meet them without a shuffle of the rows."""
    want = T.signals(spark, SF_SMALL).drop("embedding")
    got = T.signals(spark, SF_SMALL, embedding=False)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_fallback_reads_no_contents(spark, small):
    """Without a scorer the five best by similarity are found without reading a content."""
    from sigsight.plans.ask import ask

    sig, _, _, _ = small
    unread = sig.withColumn("content", F.when(F.col("content").isNotNull(), F.raise_error(F.lit("read")).cast("string")))
    _, services = catalog._services(spark, SF_SMALL)
    q = T.questions(spark, SF_SMALL)
    cols = ["qid", "rank", "event_id", "rerank_score"]
    got = ask(q, unread, services, scorer=None)["ranked"].select(cols).collect()
    assert got and sorted(got) == sorted(ask(q, sig, services, scorer=None, materialize=False)["ranked"].select(cols).collect())


def test_shuffle_files_go_after_a_checkpoint(spark):
    """The files of a plan that is checkpointed and not referred to any more are deleted when asked for."""
    import time

    from sigsight.session import cut_lineage, free_shuffles

    def files():
        at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (at.apply(i).getName() for i in range(at.size())) if name.startswith("shuffle_")}

    free_shuffles(spark)
    before = files()
    kept = cut_lineage(spark.range(1000).repartition(4, F.col("id") % 7))
    mine = files() - before
    assert mine
    until = time.time() + 20
    while mine & files() and time.time() < until:
        free_shuffles(spark)
        time.sleep(0.2)
    assert not mine & files() and kept.count() == 1000
