"""Dense-vector expressions over ``array<float>`` columns (no vector type in Spark SQL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_from_parts(dot_ab: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine clamped to [-1, 1]; null when either vector has zero length (NaN distance)."""
    denom = norm_a * norm_b
    # greatest/least skip nulls, so the zero-norm guard wraps the clamp.
    return F.when(denom > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_ab / denom)))


def similarity_score(cos: Column) -> Column:
    """The reported score: ``round(1 - distance, 4)``."""
    return F.round(F.lit(1.0) - (F.lit(1.0) - cos), 4)
