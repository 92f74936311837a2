"""Contract tables derived from the driver's TPC-H-style parquet files.

The dashboard reads ten warehouse tables that do not exist offline.  Each one
is derived here from ``customer``, ``orders``, ``lineitem``, ``part`` and
``events`` by a SQL text that means the same thing in Spark SQL and in DuckDB,
so the Spark operators and the DuckDB oracle read identical inputs.  The
mapping is documented in FIXTURES.md section 2.

Spark side: :func:`fixture_tables` returns lazy DataFrames; Catalyst prunes
columns and pushes filters through these projections into the parquet scans.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.sources.schemas import conform

# Clocks of the fixture data (FIXTURES.md section 2): the last order date for
# everything derived from orders/lineitem/part/customer, and a date three days
# after the last event for everything derived from events.
AS_OF = dt.date(2001, 8, 1)
AS_OF_EVENTS = dt.date(2024, 2, 3)

# The dealer of the registered single-dealer queries.
DEALER_CODE, DEALER_NAME = "1", "Customer#000000001"
UNKNOWN_DEALER = "No such dealer"

DRIVER_TABLES = ("customer", "orders", "lineitem", "part", "events")

# Dialect differences between Spark SQL and DuckDB used below.
_DIALECT = {
    "spark": {"json_k": "get_json_object(props, '$.k')"},
    "duckdb": {"json_k": "json_extract_string(props, '$.k')"},
}

_REQUESTS = """
SELECT
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
    || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
    || CAST(CAST(l_shipdate AS DATE) AS STRING) AS request_id,
  CAST(c_custkey AS STRING) AS dealer_code,
  c_name AS dealer_name,
  lpad(CAST(o_custkey AS STRING), 11, '0') AS dealer_phone,
  l_partkey AS vehicle_id,
  'SF-' || CAST(l_partkey - l_partkey % 4 AS STRING) AS sf_vehicle_name,
  p_name || ' ' || CAST(l_partkey AS STRING) AS car_name,
  p_brand AS car_make,
  p_type AS car_model,
  CAST(2000 + p_size % 25 AS DOUBLE) AS car_year,
  CAST((l_partkey * 7919) % 220000 AS DOUBLE) AS car_kilometrage,
  CASE WHEN o_orderpriority <> '5-LOW' AND o_custkey % 50 <> 49
       THEN 'Buy Now' ELSE 'Visit' END AS request_type,
  request_status,
  o_orderdate AS received_at,
  o_orderdate AS vehicle_request_created_at,
  CASE WHEN l_returnflag <> 'N' AND o_custkey % 10 <> 9
       THEN l_shipdate END AS wholesale_vehicle_sold_date,
  o_orderdate AS contacted_at,
  o_orderpriority AS contacted_user,
  CASE WHEN request_status <> 'Failed Before Visit' THEN l_shipdate END AS visited_at,
  'S' || CAST(l_suppkey AS STRING) AS visited_user,
  CASE WHEN request_status = 'Succeeded' THEN l_shipdate END AS succeeded_at,
  CASE WHEN request_status = 'Failed Before Visit' THEN l_shipdate END AS failed_before_visit_at,
  CASE WHEN request_status = 'Failed After Visit' THEN l_shipdate END AS failed_after_visit_at,
  CASE WHEN l_returnflag = 'N' THEN l_linestatus END AS failure_reason,
  l_extendedprice AS buy_now_price,
  l_extendedprice * (1 - l_discount) AS discounted_price,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_discount >= 0.05 END AS discount_enabled
FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag,
         l_linestatus, l_extendedprice, l_discount, l_tax,
         CASE WHEN l_returnflag = 'R' THEN 'Succeeded'
              WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Payment Log'
              WHEN l_returnflag = 'A' THEN 'Succeeded'
              WHEN l_linestatus = 'F' THEN 'Failed Before Visit'
              ELSE 'Failed After Visit' END AS request_status
  FROM {lineitem}
) li
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {part} ON l_partkey = p_partkey
"""

_DEALERS = """
SELECT CAST(c_custkey AS STRING) AS dealer_code, c_name AS dealer_name FROM {customer}
"""

_VEHICLE_HISTORY_DAY = """
SELECT
  DATE '{day}' AS date_key,
  'SF-' || CAST(p_partkey AS STRING) AS sf_vehicle_name,
  p_partkey AS vehicle_id,
  CASE WHEN p_partkey % 97 = 5 THEN NULL ELSE p_brand END AS make,
  p_type AS model,
  CASE WHEN p_partkey % 101 = 7 THEN 'n/a' ELSE CAST(2000 + p_size % 25 AS STRING) END AS year,
  (p_partkey * 7919) % 220000 + {km_bump} AS kilometers
FROM {{part}}
"""

_CAR_STATUS = """
SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' ' || CAST(p_partkey AS STRING) END AS car_name,
       p_retailprice * 0.8 AS acquisition_price,
       p_retailprice AS market_retail_price,
       p_retailprice * 1.1 AS median_asked_price,
       CAST(p_size * 10 AS DOUBLE) AS refurbishment_cost
FROM {part}
UNION ALL
SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS car_name,
       p_retailprice * 0.8 AS acquisition_price,
       p_retailprice AS market_retail_price,
       p_retailprice * 1.2 AS median_asked_price,
       CAST(p_size * 10 AS DOUBLE) AS refurbishment_cost
FROM {part} WHERE p_partkey % 60 = 3
"""

_PUBLISHING_LOGS = """
SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS vehicle_id,
       CAST(NULL AS TIMESTAMP) AS min_published,
       CAST(p_size * 997 AS DOUBLE) AS minutes_published_for
FROM {part}
"""

_DEALERS_ACTIVITY = """
SELECT CAST(user_id AS STRING) AS dealer_code,
       'Customer#' || lpad(CAST(user_id AS STRING), 9, '0')
         || CASE WHEN user_id % 50 = 0 AND day(event_date) % 2 = 0 THEN ' (alt)' ELSE '' END
         AS dealer_name,
       event_date,
       CAST(SUM(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT)
         AS all_cars_events
FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS event_date FROM {events}) ev
GROUP BY user_id, event_date
"""

_VIEW_EVENTS = """
SELECT ts AS time,
       p_brand AS make,
       p_type AS model,
       p_name AS trim,
       CAST(2000 + p_size % 25 AS BIGINT) AS year,
       CAST((p_partkey * 7919) % 220000 AS DOUBLE) AS kilometrage,
       p_type AS transmission,
       p_brand || ' ' || p_name AS listing_title,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE value * 1000 END AS buy_now_price,
       p_type AS body_style,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS entity_code
FROM (SELECT e.*, event_id % (SELECT COUNT(*) FROM {part}) AS part_slot FROM {events} e) ev
JOIN {part} ON p_partkey = part_slot
WHERE event_type = 'view'
"""

_FILTER_EVENTS = """
SELECT ts AS time,
       p_brand AS make,
       p_type AS model,
       CAST(2000 + p_size % 25 AS BIGINT) AS year,
       CAST((p_partkey * 7919) % 220000 AS DOUBLE) AS kilometrage,
       p_brand AS group_filter,
       event_type AS status,
       CAST({json_k} AS BIGINT) AS no_of_cars,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS entity_code
FROM (SELECT e.*, event_id % (SELECT COUNT(*) FROM {part}) AS part_slot FROM {events} e) ev
JOIN {part} ON p_partkey = part_slot
WHERE event_type = 'click'
"""

_LISTINGS = """
SELECT o_orderkey AS id,
       'Seller ' || CAST(o_custkey AS STRING) AS seller_name,
       '+2-' || lpad(CAST(o_custkey AS STRING), 11, '0')
         || CASE WHEN o_orderkey % 3 = 0
                 THEN ', 2' || lpad(CAST(o_custkey + 1 AS STRING), 11, '0') ELSE '' END
         AS seller_phone_number,
       p_name AS title,
       'Automatic' AS transmission_type,
       CAST(2000 + p_size % 25 AS BIGINT) AS year,
       CAST((p_partkey * 7919) % 220000 AS DOUBLE) AS kilometers,
       p_brand AS make,
       p_type AS model,
       'Cash' AS payment_options,
       'Used' AS condition,
       '1600 cc' AS engine_capacity,
       'ABS' AS extra_features,
       'White' AS color,
       'Sedan' AS body_type,
       'For Sale' AS ad_type,
       'Benzine' AS fuel_type,
       'Listing ' || CAST(o_orderkey AS STRING) AS description,
       '' AS images,
       'Cairo' AS region,
       o_totalprice AS price,
       o_orderstatus <> 'F' AS is_active,
       CAST(o_orderdate AS DATE) AS added_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deactivated_at,
       o_custkey % 2 = 0 AS is_dealer,
       o_orderdate AS created_at
FROM (SELECT o.*, o_orderkey % (SELECT COUNT(*) FROM {part}) AS part_slot FROM {orders} o) ord
JOIN {part} ON p_partkey = part_slot
"""

_DIM_DEALERS = """
SELECT c_name AS dealer_name,
       CAST(c_custkey AS STRING) AS dealer_code,
       c_mktsegment AS dealer_status,
       lower(replace(c_name, '#', '.')) || '@dealers.example' AS dealer_email,
       'City ' || CAST(c_nationkey AS STRING) AS branch_city,
       'Manager ' || CAST(c_custkey % 7 AS STRING) AS dealer_account_manager_name,
       'manager' || CAST(c_custkey % 7 AS STRING) || '@team.example'
         AS dealer_account_manager_email,
       lpad(CAST(c_custkey AS STRING), 11, '0') AS dealer_phone
FROM {customer}
"""


def _vehicle_history(as_of: dt.date) -> str:
    today = _VEHICLE_HISTORY_DAY.format(day=as_of.isoformat(), km_bump="0")
    yesterday = _VEHICLE_HISTORY_DAY.format(
        day=(as_of - dt.timedelta(days=1)).isoformat(),
        km_bump="CASE WHEN p_partkey % 50 = 1 THEN 500 ELSE 0 END")
    return today.rstrip() + "\nUNION ALL\n" + yesterday


def contract_sql(as_of: dt.date = AS_OF) -> dict[str, str]:
    """Adapter SQL per contract table, with ``{table}`` placeholders."""
    return {
        "requests": _REQUESTS,
        "dealers": _DEALERS,
        "vehicle_history": _vehicle_history(as_of),
        "car_status": _CAR_STATUS,
        "publishing_logs": _PUBLISHING_LOGS,
        "dealers_activity": _DEALERS_ACTIVITY,
        "view_events": _VIEW_EVENTS,
        "filter_events": _FILTER_EVENTS,
        "listings": _LISTINGS,
        "dim_dealers": _DIM_DEALERS,
    }


def render(sql: str, dialect: str, tables: dict[str, str] | None = None) -> str:
    """Fill dialect functions; map ``{table}`` placeholders to names."""
    names = {t: t for t in DRIVER_TABLES}
    names.update(tables or {})
    return sql.format(**names, **_DIALECT[dialect])


def duckdb_ctes(names: list[str], as_of: dt.date = AS_OF) -> str:
    """``WITH`` clauses defining the named contract tables for DuckDB."""
    sqls = contract_sql(as_of)
    parts = [f"{name} AS ({render(sqls[name], 'duckdb').strip()})" for name in names]
    return "WITH " + ",\n".join(parts)


class FixtureTables:
    """Lazy contract DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.as_of = as_of

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _build(self, name: str, **pruned: DataFrame) -> DataFrame:
        sql = contract_sql(self.as_of)[name]
        used = [t for t in DRIVER_TABLES if "{" + t + "}" in sql]
        text = render(sql, "spark", {t: "{" + t + "}" for t in used})
        return conform(self.spark.sql(text, **{t: pruned.get(t, self.raw(t)) for t in used}), name)

    def requests_of(self, dealer_name: str) -> DataFrame:
        """Requests that hold every row of ``requests`` with this dealer's name.

        Only the dealer's keys and order keys are broadcast, so the lines of all
        others are dropped where they are read instead of being shuffled.
        """
        dealers = self.raw("customer").where(F.col("c_name") == F.lit(dealer_name)).select("c_custkey")
        orders = self.raw("orders").join(F.broadcast(dealers), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        lines = self.raw("lineitem").join(F.broadcast(orders.select("o_orderkey")),
                                          F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        return self._build("requests", orders=orders, lineitem=lines)

    @cached_property
    def requests(self) -> DataFrame:
        return self._build("requests")

    @cached_property
    def dealers(self) -> DataFrame:
        return self._build("dealers")

    @cached_property
    def vehicle_history(self) -> DataFrame:
        return self._build("vehicle_history")

    @cached_property
    def car_status(self) -> DataFrame:
        return self._build("car_status")

    @cached_property
    def publishing_logs(self) -> DataFrame:
        return self._build("publishing_logs")

    @cached_property
    def dealers_activity(self) -> DataFrame:
        return self._build("dealers_activity")

    @cached_property
    def view_events(self) -> DataFrame:
        return self._build("view_events")

    @cached_property
    def filter_events(self) -> DataFrame:
        return self._build("filter_events")

    @cached_property
    def listings(self) -> DataFrame:
        return self._build("listings")

    @cached_property
    def dim_dealers(self) -> DataFrame:
        return self._build("dim_dealers")


def fixture_tables(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> FixtureTables:
    return FixtureTables(spark, sf_dir, as_of)
