"""Clock-relative windows.

All bounds are relative to an explicit ``as_of`` date (never
``current_date()``), so a run is reproducible and every bound is a literal
that Catalyst folds and pushes into the parquet scan.

The dashboard's windows have no upper bound (rows dated after ``as_of`` are
counted), and the previous-60-day window is closed at both ends, so day
``as_of - 60`` belongs to both the 60-day and the previous-60-day window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed window lengths of the dashboard, in days.
DAYS_30 = 30
DAYS_7 = 7
DAYS_60 = 60
DAYS_120 = 120


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def days_before(as_of, n: int) -> Column:
    """Literal date ``as_of - n`` days."""
    return F.lit(as_date(as_of) - dt.timedelta(days=n))


def day_of(ts: Column | str) -> Column:
    """``DATE(ts)``: a timestamp truncated to its (UTC) calendar day."""
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts)


def since(d: Column, as_of, n: int) -> Column:
    """``d >= as_of - n`` with no upper bound (W7, W30, W60)."""
    return d >= days_before(as_of, n)


def previous_60(d: Column, as_of) -> Column:
    """``d BETWEEN as_of - 120 AND as_of - 60``, inclusive (WP60)."""
    return d.between(days_before(as_of, DAYS_120), days_before(as_of, DAYS_60))
