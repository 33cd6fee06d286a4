"""Timestamp and number formatting that must equal Python's text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    """``datetime.isoformat()`` of a UTC instant: seconds, ``.ffffff`` only when non-zero, ``+00:00``."""
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


def utc_second(ts: Column) -> Column:
    """``strftime('%Y-%m-%dT%H:%M:%SZ')``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def py_float4(x: Column) -> Column:
    """``repr()`` of a Python float that was rounded to 4 decimals.

    Shortest round-trip text of such a value is its 4-decimal form with
    trailing zeros removed (one zero kept after the point).
    """
    fixed = F.format_string("%.4f", x)
    # "0.1200" -> "0.12", "1.0000" -> "1.0"
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?[1-9])0+$", "$1"), r"\.0+$", ".0")


# A full date and time of day, with or without an offset; anything looser would be completed from the clock.
_FULL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?$"


def to_utc_ntz(ts_text: Column) -> Column:
    """Parse ISO-8601 text of a date and time (``Z`` or offset) to a UTC ``timestamp_ntz``; null when it is not one."""
    text = F.trim(ts_text)
    return F.when(text.rlike(_FULL), F.try_to_timestamp(text)).cast("timestamp_ntz")
