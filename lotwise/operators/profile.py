"""Dealer profile: purchase distributions, price statistics and the profile row.

History-based operators are keyed by ``dealer_name`` by default, because
the dashboard slices the purchase history by name (so same-named dealers
merge); pass ``key="dealer_code"`` to key by code instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lotwise.functions.display import CURRENCY
from lotwise.operators.quantiles import exact_percentiles

# ---- fixed values: mileage bins, right-closed, and profile placeholders ----
MILEAGE_BINS = (("0-50K", 0, 50000), ("50K-100K", 50000, 100000),
                ("100K-150K", 100000, 150000), ("150K+", 150000, None))
NO_DATA = "No data"
TOP_MAKES, TOP_MODELS, TOP_MILEAGE = 3, 3, 2
# -----------------------------------------------------------------------------


def _rank(keys, order) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def _share(n: Column, key) -> Column:
    """Percent of the key's total; the window runs over aggregated rows only."""
    total = F.sum(n).over(Window.partitionBy(key))
    return n * F.lit(100.0) / F.nullif(total, F.lit(0))


def make_distribution(history: DataFrame, key: str = "dealer_name") -> DataFrame:
    """Purchases per make (NULL make excluded), share of all made purchases, rank."""
    counts = (history.where(F.col("make").isNotNull()).groupBy(key, "make")
              .agg(F.count(F.lit(1)).alias("purchases")))
    return counts.select(key, "make", "purchases",
                         _share(F.col("purchases"), key).alias("share_pct"),
                         _rank([key], [F.col("purchases").desc(), "make"]).alias("rank"))


def model_distribution(history: DataFrame, key: str = "dealer_name") -> DataFrame:
    """Purchases per (make, model), both non-NULL, with share and rank."""
    counts = (history.where(F.col("make").isNotNull() & F.col("model").isNotNull())
              .groupBy(key, "make", "model").agg(F.count(F.lit(1)).alias("purchases")))
    return counts.select(key, "make", "model", "purchases",
                         _share(F.col("purchases"), key).alias("share_pct"),
                         _rank([key], [F.col("purchases").desc(), "make", "model"])
                         .alias("rank"))


def mileage_bin(km: Column) -> Column:
    """Right-closed bins; 0, negatives and NULL fall in no bin."""
    expr = None
    for label, lo, hi in MILEAGE_BINS:
        cond = (km > lo) if hi is None else ((km > lo) & (km <= hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def mileage_histogram(history: DataFrame, key: str = "dealer_name") -> DataFrame:
    """Four rows per dealer with history, one per bin, zero counts included.

    Counted with one conditional aggregate per bin, then unpivoted, so no
    dealer-by-bin join is needed.
    """
    km = F.col("kilometers")
    per_dealer = history.groupBy(key).agg(*[
        F.count(F.when(mileage_bin(km) == F.lit(label), 1)).alias(f"b{i}")
        for i, (label, _, _) in enumerate(MILEAGE_BINS)])
    long = per_dealer.select(key, F.inline(F.array(*[
        F.struct(F.lit(label).alias("mileage_range"), F.lit(i).alias("bin_order"),
                 F.col(f"b{i}").alias("purchases"))
        for i, (label, _, _) in enumerate(MILEAGE_BINS)])))
    return long.select(key, "mileage_range", "purchases",
                       _share(F.col("purchases"), key).alias("share_pct"),
                       _rank([key], [F.col("purchases").desc(), "bin_order"]).alias("rank"))


_PRICE_PROBS = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def price_stats(history: DataFrame, key: str = "dealer_name") -> DataFrame:
    """Mean, min, max, sample deviation, mean +/- one deviation and exact quartiles.

    The moments come from the histograms that the quartiles are selected by.
    """
    q = exact_percentiles(history, [key], "price", _PRICE_PROBS, {
        "mean_price": "mean", "min_price": "min", "max_price": "max", "std_price": "std"})
    return q.select(
        key, "mean_price", "min_price", "max_price", "std_price",
        (F.col("mean_price") - F.col("std_price")).alias("price_band_low"),
        (F.col("mean_price") + F.col("std_price")).alias("price_band_high"),
        "p25", "median", "p75")


def price_box_by_make(history: DataFrame, key: str = "dealer_name") -> DataFrame:
    """Box-plot inputs per (dealer, make): n, min, quartiles, max."""
    q = exact_percentiles(history, [key, "make"], "price", {"q1": 0.25, "median": 0.5, "q3": 0.75},
                          {"n": "n", "min_price": "min", "max_price": "max"})
    return q.select(key, "make", "n", "min_price", "q1", "median", "q3", "max_price")


def purchase_timeline(history: DataFrame, key: str = "dealer_name") -> DataFrame:
    """Chart rows: date, price, make, model, year and kilometers, with missing
    kilometers replaced by the dealer's mean (a per-dealer aggregate joined
    back, not a window, so a large dealer is not gathered into one task)."""
    means = history.groupBy(key).agg(F.avg("kilometers").alias("km_mean")).alias("m")
    joined = history.alias("h").join(means, F.col(f"h.{key}").eqNullSafe(F.col(f"m.{key}")),
                                     "left")
    return joined.select(F.col(f"h.{key}").alias(key), "h.request_date", "h.price", "h.make",
                         "h.model", "h.year",
                         F.coalesce(F.col("h.kilometers"), F.col("m.km_mean"))
                         .alias("kilometers"))


def dealer_roster(segmentation: DataFrame) -> DataFrame:
    """Distinct (name, code) pairs plus the code chosen when a name is picked
    and the name chosen when a code is picked: the first in segmentation
    order (most lifetime requests, then code, then name)."""
    pairs = segmentation.groupBy("dealer_name", "dealer_code").agg(
        F.max("total_requests_lifetime").alias("req"))
    order = [F.col("req").desc_nulls_last(), F.col("dealer_code").asc_nulls_last(),
             F.col("dealer_name").asc_nulls_last()]
    by_name = F.first("dealer_code").over(Window.partitionBy("dealer_name").orderBy(*order))
    by_code = F.first("dealer_name").over(Window.partitionBy("dealer_code").orderBy(*order))
    return pairs.select("dealer_name", "dealer_code", by_name.alias("code_for_name"),
                        by_code.alias("name_for_code"))


def _money0(c: Column) -> Column:
    # Python formats NaN as "nan"; a missing deviation (one purchase) shows so.
    return F.coalesce(F.format_number(c, 0), F.lit("nan"))


def roster_by_name(segmentation: DataFrame) -> DataFrame:
    """The roster as the name picker lists it."""
    return dealer_roster(segmentation).orderBy(F.col("dealer_name").asc_nulls_last(),
                                               F.col("dealer_code").asc_nulls_last())


def roster_by_code(segmentation: DataFrame) -> DataFrame:
    """The roster as the code picker lists it."""
    return dealer_roster(segmentation).orderBy(F.col("dealer_code").asc_nulls_last(),
                                               F.col("dealer_name").asc_nulls_last())


def dealer_profile(segmentation: DataFrame, activity: DataFrame,
                   history: DataFrame) -> DataFrame:
    """One row per dealer name having a segmentation row and an activity row.

    The first segmentation row (most lifetime requests) and the first
    activity row (most active days, then events) of the name are used.
    History tiles are NULL and text tiles read ``No data`` without history.
    """
    seg_first = _rank(["dealer_name"], [F.col("total_requests_lifetime").desc_nulls_last(),
                                        F.col("dealer_code").asc_nulls_last()])
    seg = segmentation.withColumn("_r", seg_first).where(F.col("_r") == 1).select(
        "dealer_name", "dealer_code", "final_bucket_lifetime", "final_bucket_60d",
        "request_activity_bucket_lifetime", "request_activity_bucket_60d")
    act_first = _rank(["dealer_name"], [F.col("active_days_30d").desc(),
                                        F.col("total_car_events_30d").desc(),
                                        F.col("active_days_7d").desc(),
                                        F.col("total_car_events_7d").desc(),
                                        F.col("dealer_code").asc_nulls_last()])
    act = activity.withColumn("_r", act_first).where(F.col("_r") == 1).select(
        "dealer_name", "active_days_30d", "total_car_events_30d", "active_days_7d",
        "total_car_events_7d")

    # One aggregate over the history, per (dealer, make, model); its rows are dealt
    # by dealer once, where every later level and the joins find them.  The
    # collected lists hold a dealer's distinct makes and models.
    key = "dealer_name"
    km, price = F.col("kilometers"), F.col("price")
    bins = range(len(MILEAGE_BINS))
    pairs = history.groupBy(key, "make", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count(price).alias("priced"), F.avg(price).alias("mean"),
        (F.var_pop(price) * F.count(price)).alias("squares"),
        *[F.count(F.when(mileage_bin(km) == F.lit(label), 1)).alias(f"b{i}")
          for i, (label, _, _) in enumerate(MILEAGE_BINS)]).repartition(key)
    moment = F.struct("priced", "mean", "squares")
    makes = pairs.groupBy(key, "make").agg(
        F.sum("n").alias("n"), F.collect_list(F.when(F.col("priced") > 0, moment)).alias("moments"),
        F.collect_list(F.when(F.col("make").isNotNull() & F.col("model").isNotNull(), F.struct(
            (-F.col("n")).alias("o"), "make", "model", "n"))).alias("models"),
        *[F.sum(f"b{i}").alias(f"b{i}") for i in bins])
    per_dealer = makes.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("make").isNotNull(), F.struct(
            (-F.col("n")).alias("o"), "make", "n")))).alias("mk"),
        F.sort_array(F.flatten(F.collect_list("models"))).alias("md"),
        F.flatten(F.collect_list("moments")).alias("moments"), *[F.sum(f"b{i}").alias(f"b{i}") for i in bins])
    text = lambda array, k, fmt, *names: F.array_join(F.transform(
        F.slice(array, 1, k), lambda x: F.format_string(fmt, *[x[n] for n in names])), ", ")
    add = lambda value: F.aggregate("moments", F.lit(0.0), lambda acc, x: acc + value(x))
    per_dealer = per_dealer.withColumn("_n", add(lambda x: x["priced"].cast("double")))
    per_dealer = per_dealer.withColumn("_mean", F.when(
        F.col("_n") > 0, add(lambda x: x["mean"] * x["priced"]) / F.col("_n")))
    # squared deviations inside the pairs, and of the pairs' means
    away = add(lambda x: x["squares"] + x["priced"] * (x["mean"] - F.col("_mean")) * (x["mean"] - F.col("_mean")))
    per_dealer = per_dealer.withColumn("_std", F.when(F.col("_n") > 1, F.sqrt(away / (F.col("_n") - 1))))
    # top bins: sort (count desc, bin order) inside the row, no shuffle needed
    shown = F.array(*[F.struct((-F.col(f"b{i}")).alias("o1"), F.lit(i).alias("o2"),
                               F.format_string("%s (%d)", F.lit(label), F.col(f"b{i}")).alias("t"))
                      for i, (label, _, _) in enumerate(MILEAGE_BINS)])
    top_miles_text = F.array_join(F.transform(F.slice(F.array_sort(shown), 1, TOP_MILEAGE),
                                              lambda x: x["t"]), ", ")
    per_dealer = per_dealer.select(
        key, F.size("mk").alias("n_makes"), F.size("md").alias("n_models"),
        text("mk", TOP_MAKES, "%s (%d)", "make", "n").alias("top_makes"),
        text("md", TOP_MODELS, "%s %s (%d)", "make", "model", "n").alias("top_models"),
        top_miles_text.alias("top_mileage"),
        F.concat(F.lit(CURRENCY + " "), _money0(F.col("_mean") - F.col("_std")), F.lit(" - "),
                 _money0(F.col("_mean") + F.col("_std"))).alias("price_range"))

    out = seg.join(act, "dealer_name", "inner").join(per_dealer, "dealer_name", "left")
    has_history = F.col("price_range").isNotNull()
    return out.select(
        "dealer_name", "dealer_code", "active_days_30d", "total_car_events_30d",
        "active_days_7d", "total_car_events_7d",
        F.when(has_history, F.coalesce("n_makes", F.lit(0))).alias("n_makes"),
        F.when(has_history, F.coalesce("n_models", F.lit(0))).alias("n_models"),
        F.when(has_history, F.lit(len(MILEAGE_BINS))).alias("n_mileage_bins"),
        F.coalesce("top_makes", F.when(has_history, F.lit("")), F.lit(NO_DATA)).alias("top_makes"),
        F.coalesce("top_models", F.when(has_history, F.lit("")), F.lit(NO_DATA))
        .alias("top_models"),
        F.coalesce("top_mileage", F.lit(NO_DATA)).alias("top_mileage"),
        F.coalesce("price_range", F.lit(NO_DATA)).alias("price_range"),
        "final_bucket_lifetime", "final_bucket_60d", "request_activity_bucket_lifetime",
        "request_activity_bucket_60d")
