"""Numeric coercion matching ``pd.to_numeric(errors='coerce')``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_number(c: Column | str) -> Column:
    """Coerce to DOUBLE; unparseable text and NaN become NULL.

    ``try_cast`` never raises under ANSI mode.  NaN is mapped to NULL because
    Spark orders NaN above every number (``NaN > 0`` is true), whereas the
    dashboard treats it as missing.
    """
    col = F.col(c) if isinstance(c, str) else c
    d = col.try_cast(T.DoubleType())
    return F.when(F.isnan(d), F.lit(None).cast(T.DoubleType())).otherwise(d)


def safe_div(num: Column, den: Column) -> Column:
    """``num / NULLIF(den, 0)`` (ANSI division by zero raises)."""
    return num / F.nullif(den, F.lit(0))
