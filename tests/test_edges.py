"""Edge frames from FIXTURES.md section 4 for inventory, history, activity, listings."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from lotwise.functions.display import one_decimal
from lotwise.operators import activity, inventory, listings, profile
from lotwise.sources.schemas import (CAR_STATUS, DEALERS_ACTIVITY, DIM_DEALERS, LISTINGS,
                                     PUBLISHING_LOGS, VEHICLE_HISTORY)

from helpers import AS_OF, day, requests_frame


def _history(spark, names):
    rows = [(AS_OF, n, i, "M", "X", "2020", 1000) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, VEHICLE_HISTORY)


def _live(spark, names, sold):
    req = requests_frame(spark, [{"sf_vehicle_name": s, "request_status": "Payment Log"}
                                 for s in sold])
    return Counter(r.sf_vehicle_name for r in
                   inventory.live_inventory(_history(spark, names), req, AS_OF).collect())


def test_not_in_semantics(spark):
    assert _live(spark, ["a", "b", None], ["a"]) == Counter(["b"])   # NULL outer dropped
    assert _live(spark, ["a", "b"], ["a", None]) == Counter()        # NULL in sold: empty
    assert _live(spark, ["a", None], []) == Counter(["a", None])     # empty sold keeps all


def test_not_in_plan_has_no_nested_loop(spark):
    req = requests_frame(spark, [{"sf_vehicle_name": "a", "request_status": "Payment Log"}])
    plan = inventory.live_inventory(_history(spark, ["a"]), req, AS_OF) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_history_fan_out_and_price_rules(spark):
    req = requests_frame(spark, [
        {"vehicle_id": 1, "dealer_code": "d", "dealer_name": "D", "car_name": "c1",
         "wholesale_vehicle_sold_date": day(3), "buy_now_price": 100.0,
         "discounted_price": 90.0, "discount_enabled": None},
        {"vehicle_id": 2, "dealer_code": "d", "dealer_name": "D", "car_name": "c2",
         "wholesale_vehicle_sold_date": day(3), "buy_now_price": 100.0,
         "discounted_price": 90.0, "discount_enabled": True}])
    vh = spark.createDataFrame([(AS_OF, "v1", 1, "M", "X", "2020", 1000),
                                (AS_OF, "v1", 1, "M", "X", "2020", 1500),
                                (AS_OF, "v2", 2, "M", "Y", "n/a", 10)], VEHICLE_HISTORY)
    cost = spark.createDataFrame([("c1", 1.0, 2.0, 3.0, 4.0), ("c1", 1.0, 2.0, 3.5, 4.0)],
                                 CAR_STATUS)
    logs = spark.createDataFrame([(1, None, 2160.0), (2, None, 2159.0)], PUBLISHING_LOGS)
    rows = inventory.purchase_history(req, vh, cost, logs).collect()
    v1 = [r for r in rows if r.price == 100.0]
    v2 = [r for r in rows if r.price == 90.0]
    assert len(v1) == 4            # 2 mileages x 2 cost rows differing in a dropped column
    assert {r.time_on_app for r in v1} == {2.0}     # 1.5 days rounds half away from zero
    assert len(v2) == 1 and v2[0].year is None and v2[0].time_on_app == 1.0


def test_activity_code_only_join(spark):
    d = lambda n: AS_OF - dt.timedelta(days=n)
    rows = [("1", "A", d(2), 3), ("1", "A2", d(3), 1), ("1", "A", d(20), 1),
            ("2", "B", d(20), 5), (None, "N", d(2), 1), ("3", "C", d(2), 0)]
    act = spark.createDataFrame(rows, DEALERS_ACTIVITY)
    out = activity.dealer_activity(act, AS_OF).collect()
    assert len([r for r in out if r.dealer_code == "1"]) == 4
    assert len([r for r in out if r.dealer_code is None]) == 2
    b = [r for r in out if r.dealer_code == "2"][0]
    assert (b.active_days_30d, b.total_car_events_30d, b.active_days_7d) == (1, 5, 0)
    assert not [r for r in out if r.dealer_code == "3"]


def _listing(spark, phones, model="X"):
    names = [f.name for f in LISTINGS.fields]
    rows = []
    for i, p in enumerate(phones):
        r = dict.fromkeys(names)
        r.update(id=i, seller_phone_number=p, added_at=AS_OF, make="M", model=model,
                 price=10.0, is_active=True)
        rows.append(tuple(r[n] for n in names))
    return spark.createDataFrame(rows, LISTINGS)


def test_phone_cleaning_and_explode(spark):
    df = listings.listing_phones(_listing(spark, ["+20-10 1,,+2011", "", None]), AS_OF)
    got = sorted((r.id, r.phone_number) for r in df.collect())
    assert got == [(0, ""), (0, "0101"), (0, "011"), (1, "")]


def test_match_and_summary(spark):
    dims = spark.createDataFrame([("D", "d1", "s", "e", "c", "m", "me", "0101")], DIM_DEALERS)
    lst = _listing(spark, ["+20-10 1", "2 0101", "x"], model=None)
    m = listings.listing_match(lst, dims, AS_OF)
    assert m.count() == 2
    s = listings.listing_summary(m).first()
    assert (s.active_listings, s.unique_models) == (2, 1)


def test_mileage_bins(spark):
    km = [0.0, 50000.0, 50000.01, 150000.0, None]
    df = spark.createDataFrame([("d", k) for k in km], "dealer_name string, kilometers double")
    hist = {r.mileage_range: r.purchases for r in profile.mileage_histogram(df).collect()}
    assert hist == {"0-50K": 1, "50K-100K": 1, "100K-150K": 1, "150K+": 0}


def test_one_decimal_is_half_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.0,)], "x double")
    assert [r[0] for r in df.select(one_decimal("x")).collect()] == ["0.2", "0.3", "2.0"]


def test_display_formats(spark):
    import datetime as _dt
    from lotwise.functions import display
    df = spark.createDataFrame([(_dt.datetime(2024, 1, 2, 3, 4, 5), 1234567.5, None)],
                               "time timestamp, buy_now_price double, kilometrage double")
    row = display.format_views(df).first()
    assert (row.time, row.buy_now_price, row.kilometrage) == \
        ("2024-01-02 03:04:05", "EGP 1,234,568", "N/A")


def test_request_panels_columns_and_limit(spark):
    from lotwise.operators.requests import latest_requests
    rows = [{"dealer_code": "d", "request_status": s, "vehicle_request_created_at": day(i)}
            for i, s in enumerate(["Succeeded", "Failed Before Visit", "Failed After Visit",
                                   "Payment Log"] * 4)]
    req = requests_frame(spark, rows)
    widths = {"all": 19, "succeeded": 15, "failed_before": 14, "failed_after": 16}
    for panel, width in widths.items():
        out = latest_requests(req, panel)
        assert len(out.columns) == width + 1, panel          # + request_rank
    latest = latest_requests(req, "all").orderBy("request_rank").collect()
    assert len(latest) == 10
    assert latest[0].vehicle_request_created_at == day(0)    # newest first
    assert [r.request_rank for r in latest] == list(range(1, 11))


def test_profile_without_history_reads_no_data(spark):
    from lotwise.operators import segmentation
    from helpers import sales
    req = requests_frame(spark, sales("a", 5, 20, name="A"))
    roster = spark.createDataFrame([("a", "A"), ("b", "B")], "dealer_code string, dealer_name string")
    seg = segmentation.dealer_segmentation(req, roster, AS_OF, ordered=False)
    act = spark.createDataFrame(
        [("a", "A", 3, 9, 1, 2), ("b", "B", 1, 1, 0, 0)],
        "dealer_code string, dealer_name string, active_days_30d long, "
        "total_car_events_30d long, active_days_7d long, total_car_events_7d long")
    hist = spark.createDataFrame(
        [("A", "M", "X", 2020.0, 60000.0, 100.0), ("A", "M", "Y", 2021.0, 0.0, 300.0)],
        "dealer_name string, make string, model string, year double, kilometers double, "
        "price double")
    rows = {r.dealer_name: r for r in profile.dealer_profile(seg, act, hist).collect()}
    assert rows["B"].top_makes == "No data" and rows["B"].n_makes is None
    assert rows["A"].top_makes == "M (2)" and rows["A"].n_models == 2
    assert rows["A"].top_mileage == "50K-100K (1), 0-50K (0)"
    assert rows["A"].price_range == "EGP 59 - 341"


def test_headings(spark):
    import pytest

    from lotwise.functions import display

    df = spark.range(1).selectExpr("id AS dealer_code", "1 AS make", "2 AS year", "3 AS price")
    assert display.headed(df, display.LISTING_HEADINGS).columns == ["dealer_code", "Make", "Year", "Price"]
    assert display.headed(df, {}).columns == df.columns
    with pytest.raises(ValueError, match="Price"):
        display.headed(df, {"make": "Price", "price": "price"})
