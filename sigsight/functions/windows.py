"""Q3–Q5: question text → (window_start, window_end) relative to ``asked_at``.

Two rule tables exist (a wide one with minute/day/today support and a narrow
one used by the ask endpoint); both are CASE chains over ``lower(question)``
so the whole parse is one projection.  ``asked_at`` is always a column, never
the wall clock, which keeps results deterministic and comparable.

Overflow (a huge N pushing the start before year 1) yields a null window,
the equivalent of the request failing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE_NUMERIC = r"(?iU)(?:last|past)\s+(\d+)\s+(minutes?|hours?|days?|months?|years?)"
_NARROW_NUMERIC = r"(?iU)(?:last|past)\s+(\d+)\s+(months?|years?)"

_HOUR = 3600
_DAY = 86400


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def _back(asked_at: Column, seconds: Column) -> Column:
    """``asked_at - seconds``; null when the start would fall before 0001-01-01."""
    span = (F.datediff(F.to_date(asked_at), F.lit("0001-01-01").cast("date")).cast("double") * _DAY
            + F.hour(asked_at) * 3600 + F.minute(asked_at) * 60 + F.second(asked_at))
    secs = seconds.cast("double")
    return F.when(secs.isNull() | (secs > span), F.lit(None).cast("timestamp_ntz")).otherwise(
        F.timestamp_add("SECOND", -(seconds.cast("long")), asked_at))


def _numeric_seconds(n: Column, unit: Column) -> Column:
    unit_s = (F.when(F.startswith(unit, F.lit("minute")), F.lit(60))
              .when(F.startswith(unit, F.lit("hour")), F.lit(_HOUR))
              .when(F.startswith(unit, F.lit("day")), F.lit(_DAY))
              .when(F.startswith(unit, F.lit("month")), F.lit(30 * _DAY))
              .otherwise(F.lit(365 * _DAY)))
    # Python ints never overflow; a number beyond double range fails like Python's timedelta does.
    return F.try_multiply(n.try_cast("double"), unit_s.cast("double"))


def time_window_wide(question: Column, asked_at: Column) -> Column:
    """Struct(start, end, defaulted) by the wide rule table."""
    q = F.lower(question)
    m = F.regexp_extract(q, _WIDE_NUMERIC, 0)
    n = F.regexp_extract(q, _WIDE_NUMERIC, 1)
    unit = F.regexp_extract(q, _WIDE_NUMERIC, 2)
    literals = [(["last hour", "past hour"], _HOUR), (["last week", "past week"], 7 * _DAY),
                (["last month", "past month"], 30 * _DAY), (["last year", "past year"], 365 * _DAY)]
    # Seconds to go back; the overflow guard and subtraction are applied once.
    secs = (F.when(m != "", _numeric_seconds(n, unit))
            .when(F.contains(q, F.lit("yesterday")), F.lit(24.0 * _HOUR)))
    for phrases, sec in literals:
        secs = secs.when(_any(q, phrases), F.lit(float(sec)))
    secs = secs.otherwise(F.lit(float(_HOUR)))
    is_today = (m == "") & ~F.contains(q, F.lit("yesterday")) & F.contains(q, F.lit("today"))
    start = F.when(is_today, F.date_trunc("day", asked_at).cast("timestamp_ntz")).otherwise(_back(asked_at, secs))
    defaulted = ~((m != "") | _any(q, ["yesterday", "today"] + [p for ps, _ in literals for p in ps]))
    return F.struct(start.alias("start"), asked_at.alias("end"), defaulted.alias("defaulted"))


def time_window_narrow(question: Column, asked_at: Column) -> Column:
    """Struct(start, end, defaulted) by the narrow rule table (the one the ask path uses)."""
    q = F.lower(question)
    m = F.regexp_extract(q, _NARROW_NUMERIC, 0)
    n = F.regexp_extract(q, _NARROW_NUMERIC, 1)
    unit = F.regexp_extract(q, _NARROW_NUMERIC, 2)
    days = F.when(F.startswith(unit, F.lit("year")), F.lit(365.0)).otherwise(F.lit(30.0))
    rules = [
        (["last month", "past month"], 30 * _DAY),
        (["last year", "past year"], 365 * _DAY),
        (["last week", "past week"], 7 * _DAY),
        (["last 24 hours", "past 24 hours", "yesterday"], 24 * _HOUR),
        (["last 6 hours", "past 6 hours"], 6 * _HOUR),
        (["last 2 hours", "past 2 hours", "last two hours"], 2 * _HOUR),
    ]
    secs = F.when(m != "", F.try_multiply(n.try_cast("double"), days * _DAY))
    matched = m != ""
    for phrases, sec in rules:
        secs = secs.when(_any(q, phrases), F.lit(float(sec)))
        matched = matched | _any(q, phrases)
    secs = secs.otherwise(F.lit(float(_HOUR)))
    return F.struct(_back(asked_at, secs).alias("start"), asked_at.alias("end"), (~matched).alias("defaulted"))
