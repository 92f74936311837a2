"""Dealer segmentation: cadence metrics plus eleven threshold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import labels as L
from lotwise.operators.metrics import METRIC_COLUMNS, dealer_metrics

LABEL_COLUMNS = (
    "purchase_segment_lifetime", "purchase_segment_60d", "purchase_segment_previous_60d",
    "final_bucket_lifetime", "final_bucket_60d", "final_bucket_previous_60d",
    "current_segmentation", "request_segment_lifetime", "request_segment_60d",
    "request_activity_bucket_lifetime", "request_activity_bucket_60d")

SEGMENTATION_COLUMNS = METRIC_COLUMNS + LABEL_COLUMNS


def label_columns(df: DataFrame) -> DataFrame:
    """Append the eleven labels to a frame holding the metric columns."""
    nL, n6, nP = "total_purchases_lifetime", "total_purchases_60d", "total_purchases_previous_60d"
    gL = "lifetime_avg_days_between_purchases"
    g6 = "sixty_day_avg_days_between_purchases"
    gP = "previous_sixty_day_avg_days_between_purchases"
    rnL, rn6 = "total_requests_lifetime", "total_requests_60d"
    rgL, rg6 = "lifetime_avg_days_between_requests", "sixty_day_avg_days_between_requests"
    return df.withColumns({
        "purchase_segment_lifetime": L.purchase_segment(nL, gL),
        "purchase_segment_60d": L.purchase_segment_split(n6, g6),
        "purchase_segment_previous_60d": L.purchase_segment(nP, gP),
        "final_bucket_lifetime": L.purchase_bucket(nL, gL),
        "final_bucket_60d": L.purchase_bucket_split(n6, g6),
        "final_bucket_previous_60d": L.purchase_bucket(nP, gP),
        "current_segmentation": L.current_segmentation(nP, gP, n6, g6,
                                                       "days_since_last_purchase"),
        "request_segment_lifetime": L.request_segment(rnL, rgL),
        "request_segment_60d": L.request_segment(rn6, rg6),
        "request_activity_bucket_lifetime": L.request_bucket(rnL, rgL),
        "request_activity_bucket_60d": L.request_bucket(rn6, rg6),
    })


def dealer_segmentation(requests: DataFrame, dealers: DataFrame, as_of,
                        ordered: bool = True, dealer_code: str | None = None) -> DataFrame:
    """One row per roster dealer: 24 metrics and 11 labels.

    Sorted by ``total_requests_lifetime`` descending (NULLs last) like the
    dashboard; pass ``ordered=False`` when the consumer re-sorts anyway.  With
    ``dealer_code`` both inputs are filtered before any work.
    """
    if dealer_code is not None:
        requests = requests.where(F.col("dealer_code") == F.lit(dealer_code))
        dealers = dealers.where(F.col("dealer_code") == F.lit(dealer_code))
    out = label_columns(dealer_metrics(requests, dealers, as_of)).select(*SEGMENTATION_COLUMNS)
    if ordered:
        out = out.orderBy(F.col("total_requests_lifetime").desc_nulls_last(),
                          F.col("dealer_code").asc_nulls_last(), "dealer_name")
    return out


def purchase_segments(segmentation: DataFrame) -> DataFrame:
    return segmentation.select("dealer_code", "dealer_name", *LABEL_COLUMNS[0:3])


def purchase_buckets(segmentation: DataFrame) -> DataFrame:
    return segmentation.select("dealer_code", "dealer_name", *LABEL_COLUMNS[3:6])


def current_segmentation(segmentation: DataFrame) -> DataFrame:
    return segmentation.select("dealer_code", "dealer_name", "current_segmentation")


def request_segments(segmentation: DataFrame) -> DataFrame:
    return segmentation.select("dealer_code", "dealer_name", *LABEL_COLUMNS[7:11])
