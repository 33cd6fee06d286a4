"""Batch ingest semantics and batch-equals-stream."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from sigsight.operators.ingest import ingest
from sigsight.sources.bundle import read_signal_bundle
from sigsight.sources.sinks import append_events
from sigsight.streaming.ingest_stream import start_stream_ingest


def _bundle(tag):
    logs = [{"service": "payment-service", "occurred_at": f"2026-03-15T10:0{i}:00Z",
             "content": f"2026-03-15T10:0{i}:00Z ERROR pid={i} {tag} pool exhausted", "severity": "error",
             "metadata": {"k": i}} for i in range(3)]
    events = [{"service": "payment-service", "occurred_at": "2026-03-15T10:00:00Z",
               "content": logs[0]["content"], "event_type": "alert"},       # same key as logs[0]
              {"service": "order-service", "occurred_at": "2026-03-15T10:05:00+00:00",
               "content": f"deploy v2.3.1 {tag}"}]
    meta = [{"service": "payment-pipeline", "occurred_at": "2026-03-15T11:00:00", "content": f"job ok {tag}"},
            {"service": None, "occurred_at": "2026-03-15T11:00:00Z", "content": "no service"},
            {"service": "x", "occurred_at": "not a time", "content": "bad ts"}]
    return {"logs": logs, "events": events, "metadata": meta}


def _write(d, name, obj):
    with open(os.path.join(d, name), "w") as f:
        json.dump(obj, f)


def test_batch_ingest_counts_and_replay(spark):
    d = tempfile.mkdtemp(prefix="sig-bundle-")
    _write(d, "a.json", _bundle("a"))
    raw, _ = read_signal_bundle(spark, d)
    assert raw.count() == 8
    res = ingest(raw, None)
    counts = {r.source: (r.ingested, r.skipped, r.total) for r in res["counts"].collect()}
    # logs win the cross-source duplicate; two metadata rows are rejected
    assert counts == {"logs": (3, 0, 3), "events": (1, 1, 2), "metadata": (1, 0, 1), "total": (5, 1, 6)}
    assert res["rejected"].count() == 2
    new = res["new"]
    types = {r.content: r.event_type for r in new.collect()}
    assert types["deploy v2.3.1 a"] == "deployment" and types["job ok a"] == "metadata"
    assert types["2026-03-15T10:00:00Z ERROR pid=0 a pool exhausted"] == "log"
    norms = [sum(x * x for x in r.embedding) for r in new.select("embedding").collect()]
    assert all(abs(n - 1.0) < 1e-5 for n in norms)
    out = os.path.join(tempfile.mkdtemp(prefix="sig-store-"), "events")
    append_events(new, out)
    again = ingest(raw, spark.read.parquet(out))
    assert again["new"].count() == 0
    assert {r.source: r.skipped for r in again["counts"].collect()}["total"] == 6


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="sig-stream-src-")
    _write(d, "a.json", _bundle("a"))
    _write(d, "b.json", _bundle("b"))
    root = tempfile.mkdtemp(prefix="sig-stream-out-")
    stored = os.path.join(root, "events")
    q = start_stream_ingest(spark, d, stored, checkpoint_location=os.path.join(root, "ckpt"),
                            max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = spark.read.parquet(stored)
    batch = ingest(read_signal_bundle(spark, d)[0], None)["new"]
    assert sorted(r.event_id for r in streamed.collect()) == sorted(r.event_id for r in batch.collect())
    # A fresh checkpoint replays every file: the anti-join keeps the table unchanged.
    q2 = start_stream_ingest(spark, d, stored, checkpoint_location=os.path.join(root, "ckpt2"))
    q2.awaitTermination(300)
    assert spark.read.parquet(stored).count() == streamed.count()
    assert streamed.select(F.count_distinct("event_id")).first()[0] == streamed.count()


def test_stream_keeps_rejects_and_counts_once(spark):
    from sigsight.sources.bundle import read_bundles
    from sigsight.streaming.ingest_stream import ingest_batch_to

    d = tempfile.mkdtemp(prefix="sig-stream-bad-")
    _write(d, "a.json", _bundle("a"))
    with open(os.path.join(d, "cut.json"), "w") as f:
        f.write('{"logs": [{"service": "a"')
    root = tempfile.mkdtemp(prefix="sig-stream-bad-out-")
    stored, counts, bad = (os.path.join(root, n) for n in ("events", "counts", "bad"))
    run = ingest_batch_to(stored, counts_path=counts, rejects_path=bad)
    for _ in range(2):  # the second run is a replay of the same epoch
        run(read_bundles(spark, d), 0)
    assert [r.raw for r in spark.read.parquet(bad).collect()] == ['{"logs": [{"service": "a"']
    got = {r.source: (r.ingested, r.skipped, r.total) for r in spark.read.parquet(counts).collect()}
    assert got["total"] == (5, 1, 6) and len(got) == 4
    assert spark.read.parquet(stored).count() == 5


def test_unreadable_stored_table_is_an_error(spark):
    import pytest

    from sigsight.streaming.ingest_stream import _stored_or_none

    root = tempfile.mkdtemp(prefix="sig-broken-")
    assert _stored_or_none(spark, os.path.join(root, "none")) is None
    with open(os.path.join(root, "part-0.parquet"), "w") as f:
        f.write("this is no parquet file")
    with pytest.raises(Exception):
        _stored_or_none(spark, root)


def test_loose_timestamps_are_rejected(spark):
    from sigsight.functions.timefmt import to_utc_ntz

    loose = ["10:00", "T10:00:00", "2026", "2026-01-01", "tomorrow", "", "2026-13-01T00:00:00Z", "2026-01-01T25:00:00Z"]
    full = {"2026-01-01T10:00:00Z": "2026-01-01 10:00:00", "2026-01-01 10:00:00": "2026-01-01 10:00:00", "2026-01-01T10:00:00.25+02:00": "2026-01-01 08:00:00.25"}
    df = spark.createDataFrame([(t,) for t in [*loose, *full]], "t string").select("t", to_utc_ntz(F.col("t")).cast("string").alias("v"))
    got = {r.t: r.v for r in df.collect()}
    assert [t for t in loose if got[t] is not None] == []
    assert {t: got[t] for t in full} == full
