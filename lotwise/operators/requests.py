"""Latest vehicle requests per dealer, overall and per outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# ---- fixed values: outcome statuses and panel size ----
SUCCEEDED = "Succeeded"
FAILED_BEFORE = "Failed Before Visit"
FAILED_AFTER = "Failed After Visit"
PANEL_ROWS = 10
_CAR = ("car_name", "car_make", "car_model", "car_year", "car_kilometrage", "buy_now_price",
        "discounted_price")
_HEAD = ("dealer_code", "vehicle_request_created_at", "request_type")

PANELS = {
    "all": (None, _HEAD + ("request_status", "contacted_at", "contacted_user", "visited_at",
                           "visited_user", "succeeded_at", "failed_before_visit_at",
                           "failed_after_visit_at", "failure_reason") + _CAR),
    "succeeded": (SUCCEEDED, _HEAD + ("contacted_at", "contacted_user", "visited_at",
                                      "visited_user", "succeeded_at") + _CAR),
    "failed_before": (FAILED_BEFORE, _HEAD + ("contacted_at", "contacted_user",
                                              "failed_before_visit_at", "failure_reason") + _CAR),
    "failed_after": (FAILED_AFTER, _HEAD + ("contacted_at", "contacted_user", "visited_at",
                                            "visited_user", "failed_after_visit_at",
                                            "failure_reason") + _CAR),
}
# --------------------------------------------------------


def latest_requests(requests: DataFrame, panel: str = "all", n: int = PANEL_ROWS,
                    dealer_code: str | None = None) -> DataFrame:
    """The ``n`` most recent requests of every dealer for one panel.

    Newest ``vehicle_request_created_at`` first (NULLs last), ``request_id``
    breaking ties so the result is deterministic.  The ``row_number() <= n``
    filter lets Spark insert a partial WindowGroupLimit before the shuffle,
    so each map task sends at most ``n`` rows per dealer and a dealer with a
    huge request history does not load one task.
    """
    status, columns = PANELS[panel]
    rows = requests
    if status is not None:
        rows = rows.where(F.col("request_status") == F.lit(status))
    if dealer_code is not None:
        rows = rows.where(F.col("dealer_code") == F.lit(dealer_code))
    order = Window.partitionBy("dealer_code").orderBy(
        F.col("vehicle_request_created_at").desc_nulls_last(), F.col("request_id"))
    ranked = rows.withColumn("request_rank", F.row_number().over(order))
    return ranked.where(F.col("request_rank") <= n).select(*columns, "request_rank")
