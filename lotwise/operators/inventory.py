"""Vehicle inventory: the live (unsold) stock and the enriched purchase history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.dates import day_of
from lotwise.functions.numeric import to_number
from lotwise.operators.metrics import BUY_NOW

# ---- fixed values ----
PAYMENT_LOG = "Payment Log"
MINUTES_PER_DAY = 1440
# -----------------------

LIVE_COLUMNS = ("date_key", "sf_vehicle_name", "make", "model", "year", "kilometers")
HISTORY_COLUMNS = ("request_date", "dealer_code", "time_on_app", "price", "make", "model",
                   "year", "kilometers", "acquisition_price", "market_retail_price",
                   "dealer_name", "dealer_phone")


def sold_vehicle_names(requests: DataFrame) -> DataFrame:
    """Names of vehicles with a payment log or a sale date (may contain NULL)."""
    sold = (F.col("request_status") == F.lit(PAYMENT_LOG)) \
        | F.col("wholesale_vehicle_sold_date").isNotNull()
    return requests.where(sold).select("sf_vehicle_name")


_SOUGHT = "_sought"         # not a column of any table


def not_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``left WHERE column NOT IN (SELECT column FROM right)`` without a nested loop.

    SQL semantics: if ``right`` holds a NULL nothing survives; otherwise a
    NULL on the left never survives unless ``right`` is empty.  Spark plans
    ``NOT IN`` as a null-aware anti join only when the subquery side can be
    broadcast, and otherwise as a quadratic nested-loop join.  Here the
    right side is reduced to its distinct values (map-side combined), joined
    with an ordinary hash anti join (AQE picks broadcast or shuffle by
    size), and the two NULL rules come from one scalar aggregate over the
    right side: NULL when it is empty, 0 when it holds a NULL, else 1.
    """
    # one distinct aggregate (NULL group included) feeds both the anti join and the
    # scalar check.  Spark reuses its exchange only if both plans below it are the
    # same: as a struct the name is never NULL, so the join adds no filter of its own,
    # and counts, unlike a minimum, keep the distinct below them
    names = right.select(F.struct(column).alias(_SOUGHT)).distinct()
    nulls = F.count(F.when(F.col(_SOUGHT)[column].isNull(), 1))
    state = names.select(F.when(nulls > 0, 0).when(F.count(F.lit(1)) > 0, 1)).scalar()
    kept = left.withColumn(_SOUGHT, F.struct(column)).join(names, _SOUGHT, "left_anti").drop(_SOUGHT)
    return kept.where(state.isNull() | ((state == F.lit(1)) & F.col(column).isNotNull()))


def live_inventory(vehicle_history: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Vehicles in today's snapshot that were never sold.

    ``date_key = as_of`` is a partition filter when the history is
    partitioned by day.  Year and kilometers are coerced to numbers and
    ``date_key`` is returned as a (zone-less) timestamp, as the dashboard
    converts it.
    """
    today = vehicle_history.where(F.col("date_key") == F.lit(as_of)) \
        .select(*LIVE_COLUMNS)
    live = not_in(today, sold_vehicle_names(requests), "sf_vehicle_name")
    return live.withColumns({"date_key": F.col("date_key").cast("timestamp_ntz"),
                             "year": to_number("year"), "kilometers": to_number("kilometers")}) \
        .select(*LIVE_COLUMNS)


def effective_price() -> F.Column:
    """Discounted price when the discount flag IS TRUE, else the buy-now price."""
    return F.when(F.coalesce(F.col("discount_enabled"), F.lit(False)),
                  F.col("discounted_price")).otherwise(F.col("buy_now_price"))


def purchases(requests: DataFrame) -> DataFrame:
    """Distinct Buy Now sales with their effective price."""
    return (requests
            .where((F.col("request_type") == F.lit(BUY_NOW))
                   & F.col("wholesale_vehicle_sold_date").isNotNull())
            .select("vehicle_id", day_of("wholesale_vehicle_sold_date").alias("request_date"),
                    "dealer_code", "dealer_name", "dealer_phone", "car_name",
                    effective_price().alias("price"))
            .distinct())


def purchase_history(requests: DataFrame, vehicle_history: DataFrame,
                     car_status: DataFrame, publishing_logs: DataFrame,
                     dealer_name: str | None = None, dealer_code: str | None = None) -> DataFrame:
    """Every sale enriched with vehicle attributes, cost and time on the app.

    Three left joins that may fan out, kept on purpose: a vehicle seen with
    two mileages gives two rows, and so does a car name with two cost rows,
    even if the cost rows differ only in a column that is not returned (the
    DISTINCT runs over all five cost columns).  The two joins on
    ``vehicle_id`` come first so one shuffle of the sales serves both.
    ``request_date`` (the sale day) is returned as a zone-less timestamp,
    as the dashboard converts it.  With ``dealer_name`` or ``dealer_code`` (or
    both: the code prunes tables bucketed by it) the requests are filtered
    first, so the scan gets the filter; every operator over a history is then
    that dealer's.
    """
    for column, value in (("dealer_name", dealer_name), ("dealer_code", dealer_code)):
        if value is not None:
            requests = requests.where(F.col(column) == F.lit(value))
    sales = purchases(requests)
    logs = publishing_logs.select("vehicle_id", "minutes_published_for")
    vehicles = (vehicle_history
                .select("vehicle_id", "make", "model", "year",
                        "kilometers")
                .distinct())
    cost = car_status.select("car_name", "acquisition_price", "market_retail_price",
                             "median_asked_price", "refurbishment_cost").distinct()
    joined = (sales.join(logs, "vehicle_id", "left")
              .join(vehicles, "vehicle_id", "left")
              .join(cost, "car_name", "left"))
    return joined.select(
        F.col("request_date").cast("timestamp_ntz").alias("request_date"), "dealer_code",
        to_number(F.round(F.col("minutes_published_for") / F.lit(MINUTES_PER_DAY)))
        .alias("time_on_app"),
        to_number("price").alias("price"), "make", "model",
        to_number("year").alias("year"), to_number("kilometers").alias("kilometers"),
        to_number("acquisition_price").alias("acquisition_price"),
        to_number("market_retail_price").alias("market_retail_price"),
        "dealer_name", "dealer_phone")
