"""Threshold classifiers over the per-dealer metrics (CASE chains).

Evaluation is first match.  A NULL average makes every comparison unknown
and falls through to the last branch, exactly as in SQL; ``F.when`` chains
keep that behaviour, so no NULL handling is added here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: labels that must equal the dashboard's byte for byte ----
NO_PURCHASE = "No Purchase"
ONE_TIME = "1 Time Purchaser"
NO_REQUESTS = "No Requests"
ONE_REQUEST = "1 Request"
FREQUENT = "Frequent"
ACTIVE = "Active"
INACTIVE = "Inactive"
NEW = " (New)"
AT_RISK = " (At Risk)"
# purchase cadence bands (days between purchases): 15, 30, 60
PURCHASE_BANDS = ((15, "0-15 days"), (30, "15-30 days"), (60, "30-60 days"))
PURCHASE_TAIL = "60+ days"
# request cadence bands (days between requests): 5, 10, 21
REQUEST_BANDS = ((5, "0-5 days"), (10, "5-10 days"), (21, "10-21 days"))
REQUEST_TAIL = "21+ days"
# activity buckets: purchases Frequent <= 30 < Active <= 60; requests 10 / 21
PURCHASE_BUCKETS = ((30, FREQUENT), (60, ACTIVE))
REQUEST_BUCKETS = ((10, FREQUENT), (21, ACTIVE))
# ---------------------------------------------------------------------------


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _head(n: Column, zero: str, one: str):
    return F.when(n == 0, F.lit(zero)).when(n == 1, F.lit(one))


def banded(n, gap, bands, tail, zero=NO_PURCHASE, one=ONE_TIME) -> Column:
    """Count guard then ascending ``gap <= limit`` bands (C1, C3, C4, C6, C8-C11)."""
    n, gap = _col(n), _col(gap)
    expr = _head(n, zero, one)
    for limit, label in bands:
        expr = expr.when(gap <= limit, F.lit(label))
    return expr.otherwise(F.lit(tail))


def split_banded(n, gap, bands, tail) -> Column:
    """Bands split at their midpoint into ``(New)`` and ``(At Risk)`` (C2, C5).

    A band ``(lo, hi]`` is labelled New when ``gap <= (lo + hi) / 2``.
    """
    n, gap = _col(n), _col(gap)
    expr = _head(n, NO_PURCHASE, ONE_TIME)
    lo = 0
    for limit, label in bands:
        mid = (lo + limit) / 2
        expr = expr.when(gap <= limit, F.when(gap <= mid, F.lit(label + NEW))
                         .otherwise(F.lit(label + AT_RISK)))
        lo = limit
    return expr.otherwise(F.lit(tail))


def purchase_segment(n, gap) -> Column:
    return banded(n, gap, PURCHASE_BANDS, PURCHASE_TAIL)


def purchase_segment_split(n, gap) -> Column:
    return split_banded(n, gap, PURCHASE_BANDS, PURCHASE_TAIL)


def purchase_bucket(n, gap) -> Column:
    return banded(n, gap, PURCHASE_BUCKETS, INACTIVE)


def purchase_bucket_split(n, gap) -> Column:
    return split_banded(n, gap, PURCHASE_BUCKETS, INACTIVE)


def request_segment(n, gap) -> Column:
    return banded(n, gap, REQUEST_BANDS, REQUEST_TAIL, NO_REQUESTS, ONE_REQUEST)


def request_bucket(n, gap) -> Column:
    return banded(n, gap, REQUEST_BUCKETS, INACTIVE, NO_REQUESTS, ONE_REQUEST)


def current_segmentation(n_prev, gap_prev, n_cur, gap_cur, days_since) -> Column:
    """Transition label ``<previous 60 d> - <current 60 d>`` (C7).

    Previous side: no purchase, else Frequent/Active/Inactive by the previous
    gap (a single previous purchase has a NULL gap and lands on Inactive).
    Current side adds recency: Frequent needs the last purchase within 15
    days and Active within 30, else ``(At Risk)``; it is ``(New)`` when the
    previous gap was slower than the band or missing.
    """
    n_prev, gap_prev, n_cur, gap_cur, days_since = map(
        _col, (n_prev, gap_prev, n_cur, gap_cur, days_since))
    prev = (F.when(n_prev == 0, F.lit(NO_PURCHASE))
            .when(gap_prev <= 30, F.lit(FREQUENT))
            .when(gap_prev <= 60, F.lit(ACTIVE))
            .otherwise(F.lit(INACTIVE)))

    def recent(band_limit, recency, label):
        fresh = F.when((gap_prev > band_limit) | gap_prev.isNull(), F.lit(label + NEW)) \
                 .otherwise(F.lit(label))
        return F.when(days_since <= recency, fresh).otherwise(F.lit(label + AT_RISK))

    cur = (_head(n_cur, NO_PURCHASE, ONE_TIME)
           .when(gap_cur <= 30, recent(30, 15, FREQUENT))
           .when(gap_cur <= 60, recent(60, 30, ACTIVE))
           .otherwise(F.lit(INACTIVE)))
    return (F.when((n_prev == 0) & (n_cur == 0), F.lit(NO_PURCHASE))
            .when((n_prev == 0) & (n_cur == 1), F.lit(NO_PURCHASE + " - " + ONE_TIME))
            .when((n_prev == 1) & (n_cur == 0), F.lit(ONE_TIME + " - " + NO_PURCHASE))
            .otherwise(F.concat(prev, F.lit(" - "), cur)))
