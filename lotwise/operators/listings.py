"""Classified listings matched to dealers by phone number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.dates import DAYS_30, since
from lotwise.sources.schemas import LISTING_COLUMNS

# ---- fixed values: phone cleaning ----
PHONE_KEEP = "[^0-9,]"      # everything except digits and commas is removed
PHONE_SEPARATOR = ","
PHONE_FROM = 2              # the first digit (country prefix) is dropped
# ---------------------------------------

DEALER_COLUMNS = ("dealer_name", "dealer_code", "dealer_status", "dealer_email", "branch_city",
                  "dealer_account_manager_name", "dealer_account_manager_email")
MATCH_COLUMNS = LISTING_COLUMNS + ("phone_number",) + DEALER_COLUMNS


def listing_phones(listings: DataFrame, as_of) -> DataFrame:
    """Listings of the last 30 days, one row per phone number as written.

    The seller phone field is cleaned to digits and commas, split on commas
    (a NULL field yields no row, an empty one a single empty number) and each
    number loses its first digit.
    """
    recent = listings.where(since(F.col("added_at"), as_of, DAYS_30))
    cleaned = F.regexp_replace(F.col("seller_phone_number"), PHONE_KEEP, "")
    exploded = recent.select(*LISTING_COLUMNS,
                             F.explode(F.split(cleaned, PHONE_SEPARATOR)).alias("raw_phone"))
    return exploded.select(*LISTING_COLUMNS,
                           F.substr(F.col("raw_phone"), F.lit(PHONE_FROM)).alias("phone_number"))


def listing_match(listings: DataFrame, dim_dealers: DataFrame, as_of,
                  dealer_code: str | None = None, ordered: bool = True) -> DataFrame:
    """Recent listings whose phone number equals a dealer's phone.

    A listing matching several dealers (or one dealer through several
    numbers) appears once per match.  Dealer rows are distinct with their number,
    so one join both keeps the listings that match and brings their dealers, and
    the DISTINCT over (listing, number) runs on the matches alone; equal dealer
    rows are unfolded last.  A ``dealer_code`` filter applies to the dealer side
    before the join, so the join becomes a broadcast of a few rows.
    """
    dealers = dim_dealers.where(F.col("dealer_phone").isNotNull())
    if dealer_code is not None:
        dealers = dealers.where(F.col("dealer_code") == F.lit(dealer_code))
    dealers = dealers.groupBy(F.col("dealer_phone").alias("phone_number"), *DEALER_COLUMNS) \
        .agg(F.count(F.lit(1)).alias("copies"))
    matched = listing_phones(listings, as_of).join(dealers, "phone_number").distinct()
    out = matched.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))) \
        .select(*MATCH_COLUMNS)
    return out.orderBy(F.col("added_at").desc(), "id", "phone_number", "dealer_code",
                       "dealer_name") if ordered else out


def listing_summary(matches: DataFrame) -> DataFrame:
    """Per dealer: active listings, mean price, distinct (make, model) pairs.

    A NULL make or model counts as a value of the pair, as in a pandas
    ``drop_duplicates`` over the two columns.
    """
    return matches.groupBy("dealer_code").agg(
        F.count(F.when(F.col("is_active"), 1)).alias("active_listings"),
        F.avg("price").alias("average_price"),
        F.count_distinct(F.struct("make", "model")).alias("unique_models"))
