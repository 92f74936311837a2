"""App activity: per-dealer active days and recent event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.dates import DAYS_7, DAYS_30, day_of, since

ACTIVITY_COLUMNS = ("dealer_code", "dealer_name", "active_days_30d", "total_car_events_30d",
                    "active_days_7d", "total_car_events_7d")

VIEW_COLUMNS = ("time", "make", "model", "trim", "year", "kilometrage", "transmission",
                "listing_title", "buy_now_price", "body_style")
FILTER_COLUMNS = ("time", "make", "model", "year", "kilometrage", "group_filter", "status",
                  "no_of_cars")


def dealer_activity(activity: DataFrame, as_of, ordered: bool = True,
                    dealer_code: str | None = None) -> DataFrame:
    """Active days and car events over the last 30 and 7 days.

    Only days with ``all_cars_events > 0`` count.  Groups are (code, name);
    the 30-day and 7-day groups are then matched on the code alone with a
    full outer join, so a code seen under two names in both windows yields
    four rows, and a NULL code never matches (one row from each side).

    Plan: one scan, a day-level aggregate (map-side combined, so a hot
    dealer spreads over its days), a per-name aggregate, then the join of
    two per-name frames.
    """
    if dealer_code is not None:  # before the join, so that the scan gets it
        activity = activity.where(F.col("dealer_code") == F.lit(dealer_code))
    d = F.col("event_date")
    recent = activity.where(since(d, as_of, DAYS_30) & (F.col("all_cars_events") > 0))
    per_day = (recent.groupBy("dealer_code", "dealer_name", "event_date")
               .agg(F.sum("all_cars_events").alias("events")))
    in_7 = since(d, as_of, DAYS_7)
    per_name = (per_day.groupBy("dealer_code", "dealer_name")
                .agg(F.count(F.lit(1)).alias("active_days_30d"),
                     F.sum("events").alias("total_car_events_30d"),
                     F.count(F.when(in_7, F.lit(1))).alias("days_7"),
                     F.sum(F.when(in_7, F.col("events"))).alias("events_7")))
    d30 = per_name.select("dealer_code", "dealer_name", "active_days_30d",
                          "total_car_events_30d").alias("d30")
    d7 = (per_name.where(F.col("days_7") > 0)
          .select("dealer_code", "dealer_name", F.col("days_7").alias("active_days_7d"),
                  F.col("events_7").alias("total_car_events_7d")).alias("d7"))
    joined = d30.join(d7, F.col("d30.dealer_code") == F.col("d7.dealer_code"), "full_outer")
    out = joined.select(
        F.coalesce("d30.dealer_code", "d7.dealer_code").alias("dealer_code"),
        F.coalesce("d30.dealer_name", "d7.dealer_name").alias("dealer_name"),
        F.coalesce("d30.active_days_30d", F.lit(0)).alias("active_days_30d"),
        F.coalesce("d30.total_car_events_30d", F.lit(0)).alias("total_car_events_30d"),
        F.coalesce("d7.active_days_7d", F.lit(0)).alias("active_days_7d"),
        F.coalesce("d7.total_car_events_7d", F.lit(0)).alias("total_car_events_7d"))
    if ordered:
        out = out.orderBy(F.col("active_days_30d").desc(), F.col("total_car_events_30d").desc(),
                          F.col("dealer_code").asc_nulls_last(), "dealer_name",
                          F.col("active_days_7d").desc(), F.col("total_car_events_7d").desc())
    return out


def _recent_feed(events: DataFrame, as_of, columns, dealer_code, ordered) -> DataFrame:
    feed = events.where(since(day_of("time"), as_of, DAYS_30)
                        & F.col("entity_code").isNotNull())
    if dealer_code is not None:
        feed = feed.where(F.col("entity_code") == F.lit(dealer_code))
    out = feed.select(*columns, F.col("entity_code").alias("dealer_code"))
    return out.orderBy(F.col("time").desc(), "dealer_code", *columns[1:]) if ordered else out


def recent_views(views: DataFrame, as_of, dealer_code: str | None = None,
                 ordered: bool = True) -> DataFrame:
    """Car-profile views of the last 30 days by identified dealers, newest first."""
    return _recent_feed(views, as_of, VIEW_COLUMNS, dealer_code, ordered)


def recent_filters(filters: DataFrame, as_of, dealer_code: str | None = None,
                   ordered: bool = True) -> DataFrame:
    """Search-filter actions of the last 30 days by identified dealers, newest first."""
    return _recent_feed(filters, as_of, FILTER_COLUMNS, dealer_code, ordered)
