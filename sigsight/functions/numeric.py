"""Python-exact rounding for the few places where ties are likely.

Python's ``round(x, p)`` rounds the exact binary value half-to-even; Spark's
``round``/``bround`` round the shortest decimal text.  They differ on values
like 22.15 (binary 22.1499…).  This vectorised UDF is used only on
aggregate outputs (one row per group), never in a hot path.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_UDFS: dict[int, object] = {}


def _make(places: int):
    @pandas_udf("double")
    def _r(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else round(float(v), places)).astype("float64")
    return _r


def py_round(col: Column, places: int) -> Column:
    if places not in _UDFS:
        _UDFS[places] = _make(places)
    return _UDFS[places](col)


def exact_mean_parts(value: Column, places: int) -> tuple[Column, Column]:
    """Aggregates (units_sum, n) for ``exact_mean``: the values are ``places``-decimal numbers."""
    from pyspark.sql import functions as F

    scale = 10 ** places
    return F.sum(F.round(value * scale).cast("long")), F.count(value)


def exact_mean(units_sum: str, n: str, places: int) -> Column:
    """Mean of ``places``-decimal values rounded half away from zero at ``places``, in exact integers.

    Averaging 4-decimal scores often lands exactly on a 5th-decimal tie; summing
    doubles in an engine-dependent order then decides the rounding.  Integer
    units make the result exact and the same in every engine.
    """
    from pyspark.sql import functions as F

    scale = 10 ** places
    return F.expr(f"CASE WHEN {units_sum} >= 0 THEN (2 * {units_sum} + {n}) div (2 * {n}) "
                  f"ELSE -((-2 * {units_sum} + {n}) div (2 * {n})) END / {float(scale)}")
