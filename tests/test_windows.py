"""Both window rule tables against the phrase table of the reproduced behaviour."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sigsight.functions.windows import time_window_narrow, time_window_wide

ASKED = dt.datetime(2024, 1, 30, 15, 30, 0)
H = dt.timedelta(hours=1)
D = dt.timedelta(days=1)

CASES = [
    # phrase, wide length, narrow length
    ("errors in the last 30 minutes", dt.timedelta(minutes=30), H),
    ("what broke in the last 3 days", 3 * D, H),
    ("last 12 hours", 12 * H, H),
    ("last 2 hours", 2 * H, 2 * H),
    ("past 6 hours", 6 * H, 6 * H),
    ("last 24 hours", 24 * H, 24 * H),
    ("last two hours", H, 2 * H),
    ("yesterday", 24 * H, 24 * H),
    ("last hour", H, H),
    ("last week", 7 * D, 7 * D),
    ("past month", 30 * D, 30 * D),
    ("last year", 365 * D, 365 * D),
    ("last 3 months", 90 * D, 90 * D),
    ("past 2 years", 730 * D, 730 * D),
    ("last 2 weeks", H, H),
    ("March 15, 2026", H, H),
    ("yesterday and last month", 24 * H, 30 * D),
    ("LAST 2 HOURS", 2 * H, 2 * H),
]


def _run(spark, fn, phrases, asked=ASKED):
    df = spark.createDataFrame([(i, p, asked) for i, p in enumerate(phrases)], "i int, q string, t timestamp_ntz")
    return [r.w for r in df.orderBy("i").select(fn(F.col("q"), F.col("t")).alias("w")).collect()]


def test_wide_and_narrow_tables(spark):
    wide = _run(spark, time_window_wide, [c[0] for c in CASES])
    narrow = _run(spark, time_window_narrow, [c[0] for c in CASES])
    for (phrase, wl, nl), w, n in zip(CASES, wide, narrow):
        assert w.end == ASKED and n.end == ASKED
        assert ASKED - w.start == wl, phrase
        assert ASKED - n.start == nl, phrase


def test_today_and_defaults(spark):
    w = _run(spark, time_window_wide, ["what happened today", "nothing here"])
    assert w[0].start == dt.datetime(2024, 1, 30) and not w[0].defaulted
    assert w[1].defaulted and ASKED - w[1].start == H
    # exactly midnight: start == end (a degenerate window the search rejects)
    m = _run(spark, time_window_wide, ["today"], asked=dt.datetime(2024, 1, 30))
    assert m[0].start == m[0].end


def test_overflow_gives_null_window(spark):
    w = _run(spark, time_window_wide, ["last 999999999999 years"])
    n = _run(spark, time_window_narrow, ["last 99999999 years"])
    assert w[0].start is None and n[0].start is None


@pytest.mark.parametrize("phrase", ["last 5 minutes", "past 1 day"])
def test_numeric_units(spark, phrase):
    w = _run(spark, time_window_wide, [phrase])[0]
    assert not w.defaulted
