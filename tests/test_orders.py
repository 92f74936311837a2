"""Final row orders, which an order-free comparison cannot see."""

import os

import pytest

from lotwise.plans.registry import queries

from conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="fixture data missing")


def down(value):
    """Descending, NULLs last."""
    return (value is None, -(value or 0))


def up(value):
    return (value is None, value or "")


ORDERS = {
    "dealer_segmentation": lambda r: (down(r.total_requests_lifetime), up(r.dealer_code)),
    "dealer_activity": lambda r: (-r.active_days_30d, -r.total_car_events_30d, up(r.dealer_code)),
    "recent_views": lambda r: (-r.time.timestamp(), r.dealer_code),
    "recent_filters": lambda r: (-r.time.timestamp(), r.dealer_code),
    "listing_match": lambda r: (-r.added_at.toordinal(), r.id, r.phone_number),
    "attention_inbox": lambda r: (
        ("🔴", "🟠", "🟡", "⚪").index(r.status[0]), r.priority_score, down(r.activity_drop),
        down(r.total_requests_lifetime), r.dealer_code),
    "roster_by_name": lambda r: (up(r.dealer_name), up(r.dealer_code)),
    "roster_by_code": lambda r: (up(r.dealer_code), up(r.dealer_name)),
    "recommend_for_dealer": lambda r: (-r.match_score, r.sf_vehicle_name),
}


@pytest.mark.parametrize("key", sorted(ORDERS))
def test_rows_come_in_order(spark, key):
    rows = queries()[key](spark, SMALL).collect()
    found = [ORDERS[key](r) for r in rows]
    assert len(found) > 5
    assert found == sorted(found)
