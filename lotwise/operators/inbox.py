"""Attention inbox: dealers ranked by priority, with KPI counts and a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.priority import CRITICAL, HIGH, MEDIUM, priority_columns
from lotwise.operators.metrics import DEALER
from lotwise.operators.segmentation import SEGMENTATION_COLUMNS

INBOX_COLUMNS = SEGMENTATION_COLUMNS + ("status", "activity_drop", "priority_score")


def _with_priority(segmentation: DataFrame) -> DataFrame:
    dealers = segmentation.where(F.col("user_vs_dealer_flag") == F.lit(DEALER))
    drop = F.col("avg_requests_per_month_lifetime") - F.col("avg_requests_per_month_60d")
    return dealers.withColumns(priority_columns("current_segmentation")) \
                  .withColumn("activity_drop", drop)


def attention_inbox(segmentation: DataFrame, ordered: bool = True) -> DataFrame:
    """Purchasing dealers with status, score and request-rate drop.

    Order: status (Critical, High, Medium, Low), score ascending, drop
    descending with missing drops last (a dealer without 60-day requests),
    then the segmentation order (lifetime requests descending) and the code
    as a final tie-break.
    """
    out = _with_priority(segmentation)
    if ordered:
        out = out.orderBy(F.col("priority_rank"), F.col("priority_score"),
                          F.col("activity_drop").desc_nulls_last(),
                          F.col("total_requests_lifetime").desc_nulls_last(),
                          F.col("dealer_code"))
    return out.select(*INBOX_COLUMNS)


def inbox_kpis(segmentation: DataFrame) -> DataFrame:
    """Total cases and counts per Critical / High / Medium status (one row)."""
    inbox = _with_priority(segmentation)
    status = F.col("status")
    return inbox.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count(F.when(status == F.lit(CRITICAL), 1)).alias("critical_priority"),
        F.count(F.when(status == F.lit(HIGH), 1)).alias("high_priority"),
        F.count(F.when(status == F.lit(MEDIUM), 1)).alias("medium_priority"))


def segment_catalog(segmentation: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct segmentation labels found among dealers, with their priority."""
    labels = (segmentation.where(F.col("user_vs_dealer_flag") == F.lit(DEALER))
              .select("current_segmentation").distinct())
    out = labels.withColumns(priority_columns("current_segmentation"))
    if ordered:
        out = out.orderBy("priority_rank", "current_segmentation")
    return out.select("status", "current_segmentation", "priority_score")
