"""Range counts, timelines, order statistics, name matching, pruning and the query log against plain computations."""

import datetime as dt
import math
import os
import random
import re
import statistics
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsight.operators import access as D
from sigsight.operators import name_matching, pivot_search
from sigsight.operators import questions as Q
from sigsight.operators.evaluation import latency_percentiles
from sigsight.operators.range_counts import count_in_ranges
from sigsight.operators.selection import order_statistics
from sigsight.sources import sinks

DAY = dt.datetime(2026, 1, 1)


def _at(rng):
    """Times of which a third are one instant, and many share a minute."""
    return DAY + dt.timedelta(seconds=rng.choice([3600, rng.randrange(3600, 3660), rng.randrange(5 * 86_400)]))


def _events(spark, rng, n=400):
    rows = [(f"e{rng.randrange(n):04d}", _at(rng), rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "event_id string, occurred_at timestamp_ntz, service string, label string").repartition(5)


@pytest.mark.parametrize("groups", [[], ["label"], ["label", "service"]])
def test_counts_in_ranges(spark, groups):
    rng = random.Random(3)
    events, frame = _events(spark, rng)
    windows = []
    for i in range(400):
        a, b = _at(rng), _at(rng)
        windows.append((i, rng.choice([a, a, None]), rng.choice([b, a]), rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"])))
    asked = spark.createDataFrame(windows, "qid long, s timestamp_ntz, e timestamp_ntz, service string, label string")
    got = {r.qid: (r.first, r.n, r.last_at) for r in count_in_ranges(frame, asked, "qid", "s", "e", groups).collect()}
    want = {}
    for qid, s, e, service, label in windows:
        mine = [t for _, t, sv, lb in events if ("label" not in groups or lb == label) and ("service" not in groups or sv == service)]
        inside = [t for t in mine if s is not None and s < e and s <= t <= e]
        if inside:
            want[qid] = (sum(t < s for t in mine), len(inside), max(inside))
    assert got == want and len(want) > 20


def test_members_of_runs_are_not_broadcast(spark):
    """What a run's positions explode to is not the size of the runs."""
    events = spark.createDataFrame([(f"e{i:04d}", DAY + dt.timedelta(seconds=i % 500)) for i in range(1000)], "event_id string, occurred_at timestamp_ntz")
    asked = spark.createDataFrame([(i, DAY + dt.timedelta(seconds=400 + i)) for i in range(50)], "qid long, asked_at timestamp_ntz")
    found = D.events_before_each(asked, events, 30)
    rows = found.collect()
    assert len(rows) == sum(2 * (401 + i) for i in range(50))
    assert sorted(r.position for r in rows if r.qid == 7) == list(range(1, 2 * 408 + 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[_\w+", plan) and not re.search(r"BroadcastHashJoin \[_(place|block)", plan)


def test_runs_and_their_members(spark):
    rng = random.Random(4)
    events, frame = _events(spark, rng, 200)
    anchors = [(i, _at(rng)) for i in range(60)]
    asked = spark.createDataFrame(anchors, "qid long, asked_at timestamp_ntz")
    ordered = sorted(events, key=lambda r: r[0], reverse=True)
    ordered.sort(key=lambda r: r[1])
    runs = {r.qid: (r.first_position, r.last_position, r.n) for r in D.events_before_runs(asked, frame, 30).collect()}
    members = {}
    for r in D.events_before_each(asked, frame, 30).collect():
        members.setdefault(r.qid, []).append((r.position, r.occurred_at, r.event_id))
    for qid, at in anchors:
        inside = [i + 1 for i, r in enumerate(ordered) if at - dt.timedelta(minutes=30) <= r[1] <= at]
        assert runs.get(qid) == ((inside[0], inside[-1], len(inside)) if inside else None)
        newest = [(k, ordered[i - 1][1], ordered[i - 1][0]) for k, i in enumerate(reversed(inside), 1)]
        assert sorted(members.get(qid, [])) == newest


def test_timeline_goes_on_over_the_days_of_a_service(spark):
    events, frame = _events(spark, random.Random(5))
    for service in ("a", "b", None):
        mine = sorted((r for r in events if r[2] == service), key=lambda r: (-r[1].timestamp(), r[0]))
        got = sorted((r.position, r.occurred_at, r.event_id) for r in D.service_timeline(frame).collect() if r.service == service)
        assert got == [(i, r[1], r[0]) for i, r in enumerate(mine, 1)]


VALUES = {
    "one": [5.0], "same": [2.0] * 50, "two": [1.0, math.nextafter(1.0, 2)] * 9, "heavy": [float(i % 7) for i in range(300)] + [1e300, -1e300],
    "wide": [random.Random(i).uniform(-1, 1) * 10.0 ** random.Random(-i).randint(-200, 200) for i in range(400)],
    "tiny": [5e-324 * i for i in range(30)], "limits": [1.7976931348623157e308, -1.7976931348623157e308, 0.0, 1.0],
    "infinite": [-math.inf, -1.0, 0.0, 2.0, 2.5, math.inf, math.inf],
}


@pytest.mark.parametrize("bins", [1 << 10, 1 << 16])
def test_order_statistics(spark, bins):
    rows = [(g, v) for g, vs in VALUES.items() for v in vs] + [("one", None), ("none", None)] + [(None, 3.0), (None, 1.0)]
    random.Random(1).shuffle(rows)
    ranks = {"first": F.lit(1), "mid": F.floor((F.col("_n") + 1) / 2).cast("long"), "last": F.col("_n"), "beyond": F.col("_n") + 1}
    frame = spark.createDataFrame(rows, "g string, v double")
    if bins < 1 << 16:
        frame = frame.where("g <> 'wide' or g is null")  # ten bits a pass
    got = {r.g: (r._n, r.first, r.mid, r.last, r.beyond) for r in order_statistics(frame, "v", ["g"], ranks, bins).collect()}
    for g, vs in {**VALUES, None: [3.0, 1.0]}.items():
        s = sorted(vs)
        if not (bins < 1 << 16 and g == "wide"):
            assert got[g] == (len(s), s[0], s[(len(s) + 1) // 2 - 1], s[-1], None)
    assert "none" not in got


def test_percentiles_are_the_exclusive_ones(spark):
    rng = random.Random(2)
    values = [round(rng.lognormvariate(5, 2), 3) for _ in range(501)]
    frame = spark.createDataFrame([(v,) for v in values], "latency double").repartition(7)
    cuts = statistics.quantiles(values, n=100, method="exclusive")
    got = latency_percentiles(frame, "latency").first()
    assert abs(got.latency_ms_p50 - cuts[49]) < 0.051 and abs(got.latency_ms_p95 - cuts[94]) < 0.051
    none = latency_percentiles(frame.where("latency < 0"), "latency").collect()
    assert [tuple(r) for r in none] == [(None, None)]
    assert [tuple(r) for r in latency_percentiles(frame.limit(1), "latency").collect()][0][0] is not None


def test_names_in_blocks_and_very_long_questions(spark, monkeypatch):
    """50,000 names, one of them empty-handed, in automata of few names; a question of 100,000 characters."""
    names = [f"Svc-{i}-x" for i in range(50_000)]
    registry = spark.createDataFrame([(n, n) for n in names], "service string, ord string")
    long = "svc " * 25_000 + "svc-41-x!"
    asked = [(1, "is svc 49999 x up?"), (2, "svc-7-x and svc-12-x"), (3, long), (4, None), (5, "")]
    frame = spark.createDataFrame(asked, "qid long, question string")
    want = {1: ("Svc-49999-x",) * 2, 2: ("Svc-12-x",) * 2, 3: ("Svc-41-x",) * 2}
    for block in (name_matching.BLOCK_BYTES, 400_000):
        monkeypatch.setattr(name_matching.first_names, "__defaults__", (block,))
        got = Q.extract_services(frame, registry)
        assert {r.qid: (r.service_norm, r.service_raw) for r in got.collect()} == want
    few = spark.createDataFrame([("b", 2), ("ab", 10), ("A-b c", 9), ("", 30), (None, 1)], "service string, ord int")
    texts = spark.createDataFrame([(1, "xabx"), (2, "b"), (3, "a b c"), (4, "a-b c"), (5, "z")], "qid long, question string")
    got = {r.qid: (r.service_norm, r.service_raw) for r in Q.extract_services(texts, few).collect()}
    assert got == {1: ("b", "b"), 2: ("b", "b"), 3: ("b", "b"), 4: ("b", "b"), 5: ("", "")}


def test_only_matched_questions_leave_the_scan(spark):
    registry = spark.createDataFrame([("cart", "cart")], "service string, ord string")
    frame = spark.range(500).selectExpr("id as qid", "if(id % 100 = 0, 'is cart up', 'is it up') as question")
    forms = spark.createDataFrame([("norm", "cart", "cart", "cart"), ("raw", "cart", "cart", "cart")], "kind string, form string, ord string, service string")
    assert name_matching.first_names(frame.selectExpr("qid as _key", "question as norm", "question as raw"), forms).count() == 5
    assert Q.extract_services(frame, registry).count() == 5


def test_pruned_topk_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    vecs = [(centres[i % 12] + 0.05 * rng.standard_normal(16)).tolist() for i in range(600)]
    vecs += [[0.0] * 16, None, [1.0] * 3, vecs[0], vecs[0]]
    rows = [(f"e{i:03d}", i, DAY.date(), v) for i, v in enumerate(vecs)]
    frame = spark.createDataFrame(rows, "event_id string, id long, event_date date, embedding array<float>").repartition(3)
    pivot_search.build(frame, str(tmp_path), 24)
    stored = {r.event_id: r.embedding for r in frame.collect()}
    for q, k in ((centres[3], 10), (vecs[0], 3), (rng.standard_normal(16), 20), (centres[5], 700), (np.zeros(16), 4)):
        q = np.asarray(q, dtype=float)
        cos = {}
        for e, v in stored.items():
            ok = v is not None and len(v) == 16 and any(v) and q.any()
            cos[e] = float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)) if ok else None
        want = sorted(cos, key=lambda e: (cos[e] is None, -round(cos[e] or 0, 12), e))[:k]
        top, skipped = pivot_search.pruned_topk(spark, str(tmp_path), q.tolist(), k)
        assert [r.event_id for r in top.orderBy("rank").collect()] == want
        assert (skipped > 0.7) if k == 10 else 0 <= skipped < 1


def test_query_log_runs_count_once(spark, tmp_path):
    def logs(*ids):
        return spark.createDataFrame([(i, "q", "a", None, 0.5, 1.0, DAY) for i in ids],
                                     "id long, query string, answer string, groundedness_score double, relevance_score double, "
                                     "latency double, created_at timestamp_ntz")

    path = str(tmp_path / "logs")
    assert sinks.append_query_log(logs(1, 2), path, "run/1")
    assert not sinks.append_query_log(logs(1, 2), path, "run/1")
    # A run that died before its rename left only staging.
    logs(7).write.parquet(f"{path}.staging/run_id=late")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    assert sinks.append_query_log(logs(3), path, "late")
    assert sinks.append_query_log(logs(4), path) and sinks.append_query_log(logs(4), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 4]
    assert not os.path.exists(f"{path}.staging/run_id=late")
