"""Bucketed tables: equal results, pruned scans, vehicle joins without a shuffle."""

import os
import re

import pytest

from lotwise.operators import activity, inventory, profile, requests, segmentation
from lotwise.sources.bucketed import BUCKET_COLUMNS, BucketedTables
from lotwise.sources.fixtures import AS_OF, AS_OF_EVENTS, DEALER_CODE, DEALER_NAME, fixture_tables

from conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="fixture data missing")
BUCKETS = 8


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    plain = fixture_tables(spark, SMALL)
    tables = BucketedTables(spark, "bt", str(tmp_path_factory.mktemp("buckets")), BUCKETS, plain)
    tables.store(plain)
    yield tables
    tables.drop()


def one_dealer(t):
    """Each single-dealer result over the tables ``t``."""
    seg = segmentation.dealer_segmentation(t.requests, t.dealers, AS_OF, dealer_code=DEALER_CODE)
    act = activity.dealer_activity(t.dealers_activity, AS_OF_EVENTS, dealer_code=DEALER_CODE)
    history = inventory.purchase_history(t.requests, t.vehicle_history, t.car_status, t.publishing_logs,
                                         dealer_name=DEALER_NAME, dealer_code=DEALER_CODE)
    return {
        "dealer_segmentation": seg, "dealer_activity": act, "purchase_history": history,
        "price_stats": profile.price_stats(history), "purchase_timeline": profile.purchase_timeline(history),
        "dealer_profile": profile.dealer_profile(seg, act, history),
        "requests_latest": requests.latest_requests(t.requests, "all", dealer_code=DEALER_CODE),
        "recent_views": activity.recent_views(t.view_events, AS_OF_EVENTS, dealer_code=DEALER_CODE),
        "recent_filters": activity.recent_filters(t.filter_events, AS_OF_EVENTS, dealer_code=DEALER_CODE),
    }


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_dealer_reads_one_bucket(spark, stored):
    # a plan that needs no bucketing (a feed is only sorted) prunes buckets without showing it
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    plain = one_dealer(fixture_tables(spark, SMALL))
    by_dealer = [f"bt_{n}" for n, c in BUCKET_COLUMNS.items() if c != "vehicle_id"]
    for name, df in one_dealer(stored).items():
        scans = [line for line in plan_of(df).splitlines() if "FileScan" in line]
        facts = [line for line in scans if any(f".{t}[" in line or f"{t}[" in line for t in by_dealer)]
        assert facts, name
        for line in facts:
            assert f"SelectedBucketsCount: 1 out of {BUCKETS}" in line, (name, line[:200])
        assert sorted(map(str, df.collect())) == sorted(map(str, plain[name].collect())), name
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_the_vehicle_tables_are_joined_in_place(spark, stored):
    args = lambda t: (t.requests, t.vehicle_history, t.car_status, t.publishing_logs)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = inventory.purchase_history(*args(stored))
        lines = plan_of(df).splitlines()
        assert sum("SortMergeJoin" in line for line in lines) == 3
        for table in ("bt_vehicle_history", "bt_publishing_logs"):
            at = next(i for i, line in enumerate(lines) if "FileScan" in line and table in line)
            join = max(i for i, line in enumerate(lines[:at]) if "SortMergeJoin" in line and depth(line) < depth(lines[at]))
            assert not any("Exchange" in line and depth(line) < depth(lines[at]) and between(lines, i, at)
                           for i, line in enumerate(lines[:at]) if i > join), table
        want = inventory.purchase_history(*args(fixture_tables(spark, SMALL)))
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def depth(line):
    return len(re.match(r"[ :|+\-]*", line).group())


def between(lines, i, at):
    """Whether line ``i`` is an ancestor of line ``at``."""
    return all(depth(lines[k]) > depth(lines[i]) for k in range(i + 1, at + 1))
