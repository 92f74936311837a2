"""Input contracts: one StructType per source table the operators read.

Columns are the ones the dashboard queries touch; numeric columns whose
warehouse type is loose (year, kilometers) are normalised with ``to_number``
inside the operators, so a string or a number is accepted there.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


VEHICLE_HISTORY = _struct(
    ("date_key", _DATE), ("sf_vehicle_name", _S), ("vehicle_id", _L),
    ("make", _S), ("model", _S), ("year", _S), ("kilometers", _L))

REQUESTS = _struct(
    ("request_id", _S), ("dealer_code", _S), ("dealer_name", _S), ("dealer_phone", _S),
    ("vehicle_id", _L), ("sf_vehicle_name", _S), ("car_name", _S), ("car_make", _S),
    ("car_model", _S), ("car_year", _D), ("car_kilometrage", _D), ("request_type", _S),
    ("request_status", _S), ("received_at", _TS), ("vehicle_request_created_at", _TS),
    ("wholesale_vehicle_sold_date", _TS), ("contacted_at", _TS), ("contacted_user", _S),
    ("visited_at", _TS), ("visited_user", _S), ("succeeded_at", _TS),
    ("failed_before_visit_at", _TS), ("failed_after_visit_at", _TS), ("failure_reason", _S),
    ("buy_now_price", _D), ("discounted_price", _D), ("discount_enabled", _B))

PUBLISHING_LOGS = _struct(
    ("vehicle_id", _L), ("min_published", _TS), ("minutes_published_for", _D))

CAR_STATUS = _struct(
    ("car_name", _S), ("acquisition_price", _D), ("market_retail_price", _D),
    ("median_asked_price", _D), ("refurbishment_cost", _D))

DEALERS = _struct(("dealer_code", _S), ("dealer_name", _S))

DEALERS_ACTIVITY = _struct(
    ("dealer_code", _S), ("dealer_name", _S), ("event_date", _DATE), ("all_cars_events", _L))

VIEW_EVENTS = _struct(
    ("time", _TS), ("make", _S), ("model", _S), ("trim", _S), ("year", _L),
    ("kilometrage", _D), ("transmission", _S), ("listing_title", _S),
    ("buy_now_price", _D), ("body_style", _S), ("entity_code", _S))

FILTER_EVENTS = _struct(
    ("time", _TS), ("make", _S), ("model", _S), ("year", _L), ("kilometrage", _D),
    ("group_filter", _S), ("status", _S), ("no_of_cars", _L), ("entity_code", _S))

# ---- fixed values: listing columns, in the order of the match table ----
LISTING_COLUMNS = (
    "id", "title", "transmission_type", "year", "kilometers", "make", "model",
    "payment_options", "condition", "engine_capacity", "extra_features", "color",
    "body_type", "ad_type", "fuel_type", "description", "images", "region", "price",
    "seller_name", "is_active", "added_at", "deactivated_at", "is_dealer", "created_at")
# -------------------------------------------------------------------------

LISTINGS = _struct(
    ("id", _L), ("seller_name", _S), ("seller_phone_number", _S), ("title", _S),
    ("transmission_type", _S), ("year", _L), ("kilometers", _D), ("make", _S),
    ("model", _S), ("payment_options", _S), ("condition", _S), ("engine_capacity", _S),
    ("extra_features", _S), ("color", _S), ("body_type", _S), ("ad_type", _S),
    ("fuel_type", _S), ("description", _S), ("images", _S), ("region", _S),
    ("price", _D), ("is_active", _B), ("added_at", _DATE), ("deactivated_at", _TS),
    ("is_dealer", _B), ("created_at", _TS))

DIM_DEALERS = _struct(
    ("dealer_name", _S), ("dealer_code", _S), ("dealer_status", _S), ("dealer_email", _S),
    ("branch_city", _S), ("dealer_account_manager_name", _S),
    ("dealer_account_manager_email", _S), ("dealer_phone", _S))

CONTRACTS = {
    "vehicle_history": VEHICLE_HISTORY,
    "requests": REQUESTS,
    "publishing_logs": PUBLISHING_LOGS,
    "car_status": CAR_STATUS,
    "dealers": DEALERS,
    "dealers_activity": DEALERS_ACTIVITY,
    "view_events": VIEW_EVENTS,
    "filter_events": FILTER_EVENTS,
    "listings": LISTINGS,
    "dim_dealers": DIM_DEALERS,
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns and types of contract ``name``.

    A missing column fails here, at the scan; a cast to the type a column
    already has costs nothing and does not stop filters from being pushed.
    """
    contract = CONTRACTS[name]
    missing = [f.name for f in contract if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract])
