"""The 64-hex dedup key of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigsight.functions.timefmt import iso_utc

#: Characters of the content that its key depends on: two contents that begin with the same ones have the same key.
KEY_CHARS = 200


def event_id_hash(service: Column, occurred_at: Column, content: Column) -> Column:
    """sha256 hex of ``service|iso(occurred_at)|content[:200]`` (null if any part is null)."""
    key = F.concat(service, F.lit("|"), iso_utc(occurred_at), F.lit("|"),
                   F.substring(content, 1, KEY_CHARS))
    return F.sha2(key, 256)
