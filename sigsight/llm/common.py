"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus``: the fixed split into folds."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def slabs(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes each (one text at least)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def utf8(column: pd.Series) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [t.encode() if isinstance(t, str) else b"" for t in column]
