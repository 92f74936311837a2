"""Builders for hand-made contract frames."""

import datetime as dt

from lotwise.sources.schemas import REQUESTS

AS_OF = dt.date(2024, 6, 30)


def day(n: int) -> dt.datetime:
    """Midnight ``n`` days before AS_OF (negative = after)."""
    return dt.datetime.combine(AS_OF - dt.timedelta(days=n), dt.time())


def requests_frame(spark, rows):
    """``rows``: dicts with any REQUESTS columns; the rest are NULL."""
    names = [f.name for f in REQUESTS.fields]
    data = []
    for i, r in enumerate(rows):
        base = {"request_id": f"r{i}", "request_type": "Buy Now"}
        base.update(r)
        data.append(tuple(base.get(n) for n in names))
    return spark.createDataFrame(data, REQUESTS)


def sales(dealer, *days_ago, name=None):
    """Buy Now requests of ``dealer`` received and sold on the given days."""
    return [{"dealer_code": dealer, "dealer_name": name or f"D{dealer}",
             "received_at": day(d), "wholesale_vehicle_sold_date": day(d)} for d in days_ago]
