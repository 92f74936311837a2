"""Purchase and request cadence per dealer.

Every metric of the segmentation is a function of the multiset of
(dealer, kind, day) Buy Now events, so the request fact is scanned once and
reduced to one row per dealer, kind and day (:func:`buy_now_day_counts`),
with map-side partial aggregation before the shuffle.  A dealer holding a
third of all requests therefore spreads over its days, and the second level
(one row per dealer) reads only a few rows per dealer-day.

Two identities keep the second level a plain hash aggregate:

* distinct dates = number of day rows;
* mean gap between consecutive events (``LAG`` over the dealer's events
  ordered by date, same-day events giving gaps of 0) telescopes to
  ``(max - min) / (rows - 1)``, where rows counts events, not days.

The ``LAG`` form is still exposed by :func:`purchase_gaps` and
:func:`request_gaps`, one row per dealer, window and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lotwise.functions.dates import (DAYS_30, DAYS_60, day_of, days_before, previous_60,
                                     since)
from lotwise.functions.numeric import safe_div

# ---- fixed values ----
BUY_NOW = "Buy Now"
DEALER = "Dealer"
USER = "User"
# -----------------------

PURCHASE = "purchase"
REQUEST = "request"
LIFETIME, SIXTY, PREVIOUS_SIXTY = "lifetime", "60d", "previous_60d"

COUNT_COLUMNS = ("total_purchases_lifetime", "total_purchases_60d",
                 "total_purchases_previous_60d", "total_requests_lifetime",
                 "total_requests_60d")

METRIC_COLUMNS = (
    "dealer_code", "dealer_name", "user_vs_dealer_flag",
    "lifetime_avg_days_between_purchases", "sixty_day_avg_days_between_purchases",
    "previous_sixty_day_avg_days_between_purchases", "lifetime_avg_days_between_requests",
    "sixty_day_avg_days_between_requests", "last_purchase_date", "days_since_last_purchase",
    "last_purchase_date_previous_60d", "days_since_last_purchase_previous_60d",
    *COUNT_COLUMNS,
    "avg_purchases_per_month_lifetime", "avg_purchases_per_month_60d",
    "avg_purchases_per_month_previous_60d", "avg_requests_per_month_lifetime",
    "avg_requests_per_month_60d", "sold_cars_30d", "buy_requests_30d")


def buy_now_day_counts(requests: DataFrame) -> DataFrame:
    """``(dealer_code, kind, d, n)``: Buy Now events per dealer, kind and day.

    kind ``purchase`` is dated by ``DATE(wholesale_vehicle_sold_date)``, kind
    ``request`` by ``DATE(received_at)``; undated events are dropped since no
    metric counts them.  One scan, unpivoted in place, then aggregated with a
    map-side combine.
    """
    events = requests.where(F.col("request_type") == F.lit(BUY_NOW)).select(
        "dealer_code",
        F.inline(F.array(
            F.struct(F.lit(PURCHASE).alias("kind"),
                     day_of("wholesale_vehicle_sold_date").alias("d")),
            F.struct(F.lit(REQUEST).alias("kind"), day_of("received_at").alias("d")))))
    return (events.where(F.col("d").isNotNull())
            .groupBy("dealer_code", "kind", "d")
            .agg(F.count(F.lit(1)).alias("n")))


class _Days:
    """Conditional aggregates over day-count rows ``(kind, d, n)``."""

    def __init__(self, as_of):
        self.as_of = as_of
        d = F.col("d")
        self.d = d
        self.p = F.col("kind") == F.lit(PURCHASE)
        self.r = F.col("kind") == F.lit(REQUEST)
        self.w60 = since(d, as_of, DAYS_60)
        self.wp60 = previous_60(d, as_of)
        self.w30 = since(d, as_of, DAYS_30)

    def days(self, cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1)))

    def events(self, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")))

    def last(self, cond: Column) -> Column:
        return F.max(F.when(cond, self.d))

    def mean_gap(self, cond: Column) -> Column:
        span = F.datediff(F.max(F.when(cond, self.d)), F.min(F.when(cond, self.d)))
        return safe_div(span, self.events(cond) - F.lit(1))


def _month_rollup(days: DataFrame, as_of) -> DataFrame:
    """Day rows to one row per (dealer, kind, month) with per-window partials.

    For each window: days with events, events, first and last day.  A month
    counts for a window's per-month rate when it has a day in that window.
    """
    k = _Days(as_of)
    windows = {"l": F.lit(True), "s": k.w60, "p": k.wp60, "t": k.w30}
    parts = []
    for w, cond in windows.items():
        parts += [F.count(F.when(cond, F.lit(1))).alias(f"days_{w}"),
                  F.sum(F.when(cond, F.col("n"))).alias(f"events_{w}"),
                  F.min(F.when(cond, k.d)).alias(f"first_{w}"),
                  F.max(F.when(cond, k.d)).alias(f"last_{w}")]
    return days.groupBy("dealer_code", "kind", F.trunc(k.d, "MM").alias("month")).agg(*parts)


def dealer_metrics_by_code(requests: DataFrame, as_of) -> DataFrame:
    """All cadence metrics for every dealer code with a Buy Now event."""
    return metrics_from_days(buy_now_day_counts(requests), as_of)


def metrics_from_days(days_: DataFrame, as_of) -> DataFrame:
    """All cadence metrics from (dealer_code, kind, d, n) rows, one per dealer, kind and day.

    Three hash aggregates, each over the previous one's much smaller output:
    (dealer, kind, day) -> (dealer, kind, month) -> dealer.  All stay
    code-generated hash aggregates (no collect or count-distinct expansion).
    """
    months = _month_rollup(days_, as_of)
    p = F.col("kind") == F.lit(PURCHASE)
    r = F.col("kind") == F.lit(REQUEST)

    def days(kind, w):
        return F.sum(F.when(kind, F.col(f"days_{w}"))).cast("bigint")

    def events(kind, w):
        return F.sum(F.when(kind, F.col(f"events_{w}")))

    def first(kind, w):
        return F.min(F.when(kind, F.col(f"first_{w}")))

    def last(kind, w):
        return F.max(F.when(kind, F.col(f"last_{w}")))

    def mean_gap(kind, w):
        return safe_div(F.datediff(last(kind, w), first(kind, w)), events(kind, w) - F.lit(1))

    def per_month(kind, w):
        n_months = F.count(F.when(kind & (F.col(f"days_{w}") > 0), F.lit(1)))
        return F.round(safe_div(F.coalesce(days(kind, w), F.lit(0)), n_months), 2)

    return months.groupBy("dealer_code").agg(
        mean_gap(p, "l").alias("lifetime_avg_days_between_purchases"),
        mean_gap(p, "s").alias("sixty_day_avg_days_between_purchases"),
        mean_gap(p, "p").alias("previous_sixty_day_avg_days_between_purchases"),
        mean_gap(r, "l").alias("lifetime_avg_days_between_requests"),
        mean_gap(r, "s").alias("sixty_day_avg_days_between_requests"),
        last(p, "l").alias("last_purchase_date"),
        F.datediff(F.lit(as_of), last(p, "l")).cast("bigint").alias("days_since_last_purchase"),
        last(p, "p").alias("last_purchase_date_previous_60d"),
        F.datediff(days_before(as_of, DAYS_60), last(p, "p")).cast("bigint")
        .alias("days_since_last_purchase_previous_60d"),
        days(p, "l").alias("total_purchases_lifetime"),
        days(p, "s").alias("total_purchases_60d"),
        days(p, "p").alias("total_purchases_previous_60d"),
        days(r, "l").alias("total_requests_lifetime"),
        days(r, "s").alias("total_requests_60d"),
        per_month(p, "l").alias("avg_purchases_per_month_lifetime"),
        per_month(p, "s").alias("avg_purchases_per_month_60d"),
        per_month(p, "p").alias("avg_purchases_per_month_previous_60d"),
        per_month(r, "l").alias("avg_requests_per_month_lifetime"),
        per_month(r, "s").alias("avg_requests_per_month_60d"),
        events(p, "t").alias("sold_cars_30d"),
        events(r, "t").alias("buy_requests_30d"))


def dealer_metrics(requests: DataFrame, dealers: DataFrame, as_of) -> DataFrame:
    """The 24 metric columns for every (dealer_code, dealer_name) of the roster.

    Roster rows with the same code and name collapse; a dealer without
    events has zero counts, NULL averages and NULL 30-day counts, and is a
    ``User``.  A NULL code never matches an event.
    """
    return metrics_of_roster(dealer_metrics_by_code(requests, as_of), dealers)


def metrics_of_roster(by_code: DataFrame, dealers: DataFrame) -> DataFrame:
    """The metric columns of every roster row, from the metrics of the codes with events."""
    roster = dealers.select("dealer_code", "dealer_name").distinct()
    joined = roster.join(by_code, "dealer_code", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in COUNT_COLUMNS}
    flag = F.when(F.col("total_purchases_lifetime") > 0, F.lit(DEALER)).otherwise(F.lit(USER))
    return joined.withColumns(counts).withColumn("user_vs_dealer_flag", flag) \
        .select(*METRIC_COLUMNS)


# ---- the per-window views of the same day counts ----

def _windowed_days(requests: DataFrame, kind: str, windows) -> DataFrame:
    days = buy_now_day_counts(requests).where(F.col("kind") == F.lit(kind))
    d = F.col("d")
    tags = F.array(*[F.when(cond(d), F.lit(name)) for name, cond in windows])
    return days.select("dealer_code", "d", "n",
                       F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("period"))


def _gaps(requests, kind, windows, date_name, count_name) -> DataFrame:
    days = _windowed_days(requests, kind, windows)
    order = Window.partitionBy("dealer_code", "period").orderBy("d")
    return days.select(
        "dealer_code", "period", F.col("d").alias(date_name),
        F.col("n").alias(count_name),
        F.datediff(F.col("d"), F.lag("d").over(order)).cast("bigint")
        .alias("days_since_previous"))


def purchase_gaps(requests: DataFrame, as_of) -> DataFrame:
    """``LAG`` gaps between purchase days per dealer and window.

    One row per (dealer, window, purchase day): ``n_purchases`` events fell
    on the day, ``days_since_previous`` is the gap to the dealer's previous
    purchase day in the same window (NULL for the first).  Expanded to one
    row per event this is exactly the per-event ``LAG`` output: the first
    event of a day carries the gap and the others a gap of 0.  The window
    partition is a dealer's *days*, never its raw events, so a hot dealer
    cannot overload one task.
    """
    windows = ((LIFETIME, lambda d: F.lit(True)),
               (SIXTY, lambda d: since(d, as_of, DAYS_60)),
               (PREVIOUS_SIXTY, lambda d: previous_60(d, as_of)))
    return _gaps(requests, PURCHASE, windows, "purchase_date", "n_purchases")


def request_gaps(requests: DataFrame, as_of) -> DataFrame:
    """As :func:`purchase_gaps`, for Buy Now requests (lifetime and 60 days)."""
    windows = ((LIFETIME, lambda d: F.lit(True)),
               (SIXTY, lambda d: since(d, as_of, DAYS_60)))
    return _gaps(requests, REQUEST, windows, "request_date", "n_requests")


def purchase_intervals(requests: DataFrame, as_of) -> DataFrame:
    """Mean days between purchases (lifetime, 60 d, previous 60 d) per dealer code."""
    k = _Days(as_of)
    return (buy_now_day_counts(requests).where(k.p).groupBy("dealer_code").agg(
        k.mean_gap(k.p).alias("lifetime_avg_days_between_purchases"),
        k.mean_gap(k.p & k.w60).alias("sixty_day_avg_days_between_purchases"),
        k.mean_gap(k.p & k.wp60).alias("previous_sixty_day_avg_days_between_purchases")))


def request_intervals(requests: DataFrame, as_of) -> DataFrame:
    """Mean days between Buy Now requests (lifetime, 60 d) per dealer code."""
    k = _Days(as_of)
    return (buy_now_day_counts(requests).where(k.r).groupBy("dealer_code").agg(
        k.mean_gap(k.r).alias("lifetime_avg_days_between_requests"),
        k.mean_gap(k.r & k.w60).alias("sixty_day_avg_days_between_requests")))


def last_purchase(requests: DataFrame, as_of) -> DataFrame:
    """Last purchase day overall and within the previous 60 days, with day counts."""
    k = _Days(as_of)
    last = k.last(k.p)
    last_prev = k.last(k.p & k.wp60)
    return (buy_now_day_counts(requests).where(k.p).groupBy("dealer_code").agg(
        last.alias("last_purchase_date"),
        F.datediff(F.lit(as_of), last).cast("bigint").alias("days_since_last_purchase"),
        last_prev.alias("last_purchase_date_previous_60d"),
        F.datediff(days_before(as_of, DAYS_60), last_prev).cast("bigint")
        .alias("days_since_last_purchase_previous_60d")))


def window_event_counts(requests: DataFrame, as_of) -> DataFrame:
    """Buy Now requests and sales of the last 30 days (event rows, not days).

    One row per dealer code with either; a count is NULL, not 0, when the
    dealer had none of that kind.
    """
    k = _Days(as_of)
    return (buy_now_day_counts(requests).where(k.w30).groupBy("dealer_code").agg(
        k.events(k.r).alias("buy_requests_30d"),
        k.events(k.p).alias("sold_cars_30d")))
