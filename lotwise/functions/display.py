"""Presentation formats used on the dashboard, as native Spark expressions.

Core operators return typed columns; these helpers turn them into the
display strings on request.  ``format_number`` rounds half-to-even on the
binary value, which is what Python's ``format(x, ',.0f')`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: display patterns of the dashboard ----
TS_SECONDS = "yyyy-MM-dd HH:mm:ss"
TS_MINUTES = "yyyy-MM-dd HH:mm"
MISSING = "N/A"
CURRENCY = "EGP"
REQUEST_HEADINGS = {
    "vehicle_request_created_at": "Request Date",
    "request_type": "Request Type",
    "request_status": "Status",
    "contacted_at": "Contacted At",
    "contacted_user": "Contacted By",
    "visited_at": "Visit Date",
    "visited_user": "Visited By",
    "succeeded_at": "Success Date",
    "failed_before_visit_at": "Failed Before Visit At",
    "failed_after_visit_at": "Failed After Visit At",
    "failure_reason": "Failure Reason",
    "car_name": "Car Name",
    "car_make": "Make",
    "car_model": "Model",
    "car_year": "Year",
    "car_kilometrage": "Mileage",
    "buy_now_price": "Buy Now Price",
    "discounted_price": "Discounted Price",
}
VIEW_HEADINGS = {
    "time": "Viewed At",
    "make": "Make",
    "model": "Model",
    "trim": "Trim",
    "year": "Year",
    "kilometrage": "Mileage",
    "transmission": "Transmission",
    "buy_now_price": "Price",
    "body_style": "Body Style",
}
FILTER_HEADINGS = {
    "time": "Filter Applied At",
    "make": "Make",
    "model": "Model",
    "year": "Year",
    "kilometrage": "Mileage Range",
    "group_filter": "Filter Group",
    "status": "Status",
    "no_of_cars": "Number of Cars",
}
LISTING_HEADINGS = {
    "added_at": "Listed Date",
    "title": "Title",
    "make": "Make",
    "model": "Model",
    "year": "Year",
    "kilometers": "Mileage",
    "price": "Price",
    "condition": "Condition",
    "is_active": "Active",
    "region": "Region",
}
# ----------------------------------------------------------

REQUEST_TIME_COLUMNS = ("vehicle_request_created_at", "contacted_at", "visited_at",
                        "succeeded_at", "failed_before_visit_at", "failed_after_visit_at")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def money_prefix(c) -> Column:
    """``EGP 1,234`` or ``N/A``."""
    return F.coalesce(F.concat(F.lit(CURRENCY + " "), F.format_number(_col(c), 0)),
                      F.lit(MISSING))


def money_suffix(c) -> Column:
    """``1,234 EGP`` or ``N/A``."""
    return F.coalesce(F.concat(F.format_number(_col(c), 0), F.lit(" " + CURRENCY)),
                      F.lit(MISSING))


def kilometres(c) -> Column:
    """``12,345 km`` or ``N/A``."""
    return F.coalesce(F.concat(F.format_number(_col(c), 0), F.lit(" km")), F.lit(MISSING))


def one_decimal(c) -> Column:
    """Python's ``f"{x:.1f}"`` (half-to-even on the binary value, no grouping)."""
    return F.regexp_replace(F.format_number(_col(c), 1), ",", "")


def timestamp_text(c, pattern: str = TS_SECONDS) -> Column:
    return F.date_format(_col(c), pattern)


def format_requests(df: DataFrame) -> DataFrame:
    """Display form of a request panel: times as text, prices and km as text."""
    cols = {}
    for name in REQUEST_TIME_COLUMNS:
        if name in df.columns:
            cols[name] = timestamp_text(name)
    for name in ("buy_now_price", "discounted_price"):
        if name in df.columns:
            cols[name] = money_prefix(name)
    if "car_kilometrage" in df.columns:
        cols["car_kilometrage"] = kilometres("car_kilometrage")
    return df.withColumns(cols)


def format_views(df: DataFrame) -> DataFrame:
    """Recent views as shown: time text, price ``EGP``, kilometrage ``km``."""
    return df.withColumns({"time": timestamp_text("time"),
                           "buy_now_price": money_prefix("buy_now_price"),
                           "kilometrage": kilometres("kilometrage")})


def format_filters(df: DataFrame) -> DataFrame:
    """Recent filters as shown: time text and kilometrage ``km``."""
    return df.withColumns({"time": timestamp_text("time"),
                           "kilometrage": kilometres("kilometrage")})


def format_listings(df: DataFrame) -> DataFrame:
    """Listing panel columns with minute timestamps and ``1,234 EGP`` prices."""
    return df.select(timestamp_text("added_at", TS_MINUTES).alias("added_at"), "title", "make",
                     "model", "year", "kilometers", money_suffix("price").alias("price"),
                     "condition", "is_active", "region")


def headed(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    """The frame under display headings; columns without one keep their name.

    A panel that lacks a column is fine.  A heading that another column already
    has, letter case aside, is an error, since the result would be ambiguous.
    """
    names = [headings.get(c, c) for c in df.columns]
    lowered = [n.lower() for n in names]
    twice = sorted({n for n in names if lowered.count(n.lower()) > 1})
    if twice:
        raise ValueError(f"more than one column would be named {', '.join(twice)}")
    return df.toDF(*names)
