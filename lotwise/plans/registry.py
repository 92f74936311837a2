"""Registered queries: each key builds one operator over a scale-factor folder.

Every callable takes ``(spark, sf_dir)``, derives the contract tables from
the driver's parquet files and returns the operator's DataFrame over the whole
tables.  All are lazy but ``recommend_cars``, which writes four small tables to
the shared checkpoint folder while its plan is built, and the ``snapshot_*`` keys,
which read the start-up results back from a snapshot and write it where it is not
fresh.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import (activity, inbox, inventory, listings, metrics, profile,
                               recommend, requests, segmentation)
from lotwise.functions import display
from lotwise.functions.dates import DAYS_30, day_of, since
from lotwise.session import scratch
from lotwise.sources.cadence import CadenceState
from lotwise.sources.fixtures import AS_OF, AS_OF_EVENTS, DEALER_CODE, DEALER_NAME, UNKNOWN_DEALER, fixture_tables
from lotwise.sources.snapshot import SNAPSHOT_NAMES, dashboard_frames, snapshot

Query = Callable[[SparkSession, str], DataFrame]


def _seg(spark, sf_dir, ordered=False) -> DataFrame:
    t = fixture_tables(spark, sf_dir)
    return segmentation.dealer_segmentation(t.requests, t.dealers, AS_OF, ordered=ordered)


def dealer_activity(spark, sf_dir):
    return activity.dealer_activity(fixture_tables(spark, sf_dir).dealers_activity, AS_OF_EVENTS)


def recent_views(spark, sf_dir):
    return activity.recent_views(fixture_tables(spark, sf_dir).view_events, AS_OF_EVENTS)


def recent_filters(spark, sf_dir):
    return activity.recent_filters(fixture_tables(spark, sf_dir).filter_events, AS_OF_EVENTS)


def _requests_op(op):
    def run(spark, sf_dir):
        return op(fixture_tables(spark, sf_dir).requests, AS_OF)
    run.__name__ = op.__name__
    return run


def dealer_metrics(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return metrics.dealer_metrics(t.requests, t.dealers, AS_OF)


def dealer_segmentation(spark, sf_dir):
    return _seg(spark, sf_dir, ordered=True)


def _seg_view(op):
    def run(spark, sf_dir):
        return op(_seg(spark, sf_dir))
    run.__name__ = op.__name__
    return run


def attention_inbox(spark, sf_dir):
    return inbox.attention_inbox(_seg(spark, sf_dir))


def live_inventory(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return inventory.live_inventory(t.vehicle_history, t.requests, AS_OF)


def purchase_history(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return inventory.purchase_history(t.requests, t.vehicle_history, t.car_status,
                                      t.publishing_logs)


def history_for_dealer(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return inventory.purchase_history(t.requests_of(DEALER_NAME), t.vehicle_history, t.car_status,
                                      t.publishing_logs, dealer_name=DEALER_NAME)


def segmentation_for_dealer(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    return segmentation.dealer_segmentation(t.requests, t.dealers, AS_OF, dealer_code=DEALER_CODE)


def activity_for_dealer(spark, sf_dir):
    return activity.dealer_activity(fixture_tables(spark, sf_dir).dealers_activity, AS_OF_EVENTS,
                                    dealer_code=DEALER_CODE)


def profile_for_dealer(spark, sf_dir):
    return profile.dealer_profile(segmentation_for_dealer(spark, sf_dir), activity_for_dealer(spark, sf_dir),
                                  history_for_dealer(spark, sf_dir))


def recommend_for_dealer(spark, sf_dir):
    return recommend.recommend_for_dealer(history_for_dealer(spark, sf_dir), live_inventory(spark, sf_dir),
                                          DEALER_NAME)


def _shown(form, query):
    def run(spark, sf_dir):
        return form(query(spark, sf_dir))
    run.__name__ = form.__name__
    return run


def _headed(headings, form, query):
    return _shown(lambda df: display.headed(form(df), headings), query)


def _history_op(op):
    def run(spark, sf_dir):
        return op(purchase_history(spark, sf_dir))
    run.__name__ = op.__name__
    return run


def recommend_cars(spark, sf_dir):
    return recommend.recommend_cars(purchase_history(spark, sf_dir),
                                    live_inventory(spark, sf_dir), top_k=10)


def _panel(name):
    def run(spark, sf_dir):
        return requests.latest_requests(fixture_tables(spark, sf_dir).requests, name)
    run.__name__ = f"requests_{name}"
    return run


def listing_match(spark, sf_dir, ordered=True):
    t = fixture_tables(spark, sf_dir)
    return listings.listing_match(t.listings, t.dim_dealers, AS_OF, ordered=ordered)


def listing_summary(spark, sf_dir):
    return listings.listing_summary(listing_match(spark, sf_dir, ordered=False))


def dealer_profile(spark, sf_dir):
    t = fixture_tables(spark, sf_dir)
    act = activity.dealer_activity(t.dealers_activity, AS_OF_EVENTS, ordered=False)
    return profile.dealer_profile(_seg(spark, sf_dir), act, purchase_history(spark, sf_dir))


def profile_without_history(spark, sf_dir):
    """The profile's "no data" form: nothing was ever bought."""
    t = fixture_tables(spark, sf_dir)
    act = activity.dealer_activity(t.dealers_activity, AS_OF_EVENTS, ordered=False)
    return profile.dealer_profile(_seg(spark, sf_dir), act, purchase_history(spark, sf_dir).where(F.lit(False)))


def history_of_unknown_dealer(spark, sf_dir):
    """An empty result with all its columns."""
    t = fixture_tables(spark, sf_dir)
    return inventory.purchase_history(t.requests_of(UNKNOWN_DEALER), t.vehicle_history, t.car_status,
                                      t.publishing_logs, dealer_name=UNKNOWN_DEALER)


def _read_back(spark, sf_dir, names) -> dict[str, DataFrame]:
    """Start-up results through the snapshot that this application keeps of ``sf_dir``."""
    root = scratch(spark, f"snapshot-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}", new=False)
    frames = dashboard_frames(fixture_tables(spark, sf_dir), AS_OF, AS_OF_EVENTS)
    return snapshot({name: frames[name] for name in names}, root, AS_OF, dt.datetime.now())


def _from_snapshot(name):
    def run(spark, sf_dir):
        return _read_back(spark, sf_dir, [name])[name]
    run.__name__ = f"snapshot_{name}"
    return run


def snapshot_readback(spark, sf_dir):
    """Rows of each of the six results, counted after reading them back."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("frame"), "n_rows")
             for name, df in _read_back(spark, sf_dir, SNAPSHOT_NAMES).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metrics_from_state(spark, sf_dir):
    """The metrics from stored day counts: all earlier requests, then the last month's folded in."""
    t = fixture_tables(spark, sf_dir)
    state = CadenceState(spark, scratch(spark, "cadence"))
    last = F.coalesce(since(day_of("received_at"), AS_OF, DAYS_30), F.lit(False))
    state.fold("before", t.requests.where(~last))
    state.fold("last", t.requests.where(last))
    return state.dealer_metrics(t.dealers, AS_OF)


def queries() -> dict[str, Query]:
    return {
        "dealer_metrics_from_state": metrics_from_state,
        **{f"snapshot_{name}": _from_snapshot(name) for name in SNAPSHOT_NAMES},
        "snapshot_readback": snapshot_readback,
        "dealer_profile_without_history": profile_without_history,
        "purchase_history_of_unknown_dealer": history_of_unknown_dealer,
        "dealer_activity": dealer_activity,
        "recent_views": recent_views,
        "recent_filters": recent_filters,
        "window_event_counts": _requests_op(metrics.window_event_counts),
        "purchase_gaps": _requests_op(metrics.purchase_gaps),
        "request_gaps": _requests_op(metrics.request_gaps),
        "purchase_intervals": _requests_op(metrics.purchase_intervals),
        "request_intervals": _requests_op(metrics.request_intervals),
        "last_purchase": _requests_op(metrics.last_purchase),
        "dealer_metrics": dealer_metrics,
        "purchase_segments": _seg_view(segmentation.purchase_segments),
        "purchase_buckets": _seg_view(segmentation.purchase_buckets),
        "current_segmentation": _seg_view(segmentation.current_segmentation),
        "request_segments": _seg_view(segmentation.request_segments),
        "dealer_segmentation": dealer_segmentation,
        "attention_inbox": attention_inbox,
        "inbox_kpis": _seg_view(inbox.inbox_kpis),
        "segment_catalog": _seg_view(inbox.segment_catalog),
        "live_inventory": live_inventory,
        "purchase_history": purchase_history,
        "dealer_preferences": _history_op(recommend.dealer_preferences),
        "recommend_cars": recommend_cars,
        "requests_latest": _panel("all"),
        "requests_succeeded": _panel("succeeded"),
        "requests_failed_before": _panel("failed_before"),
        "requests_failed_after": _panel("failed_after"),
        "listing_match": listing_match,
        "listing_summary": listing_summary,
        "dealer_roster": _seg_view(profile.dealer_roster),
        "make_distribution": _history_op(profile.make_distribution),
        "model_distribution": _history_op(profile.model_distribution),
        "mileage_histogram": _history_op(profile.mileage_histogram),
        "price_stats": _history_op(profile.price_stats),
        "price_box_by_make": _history_op(profile.price_box_by_make),
        "purchase_timeline": _history_op(profile.purchase_timeline),
        "dealer_profile": dealer_profile,
        "roster_by_name": _seg_view(profile.roster_by_name),
        "roster_by_code": _seg_view(profile.roster_by_code),
        "recommend_for_dealer": recommend_for_dealer,
        "purchase_history_for_dealer": history_for_dealer,
        "price_stats_for_dealer": _shown(profile.price_stats, history_for_dealer),
        "purchase_timeline_for_dealer": _shown(profile.purchase_timeline, history_for_dealer),
        "dealer_segmentation_for_dealer": segmentation_for_dealer,
        "dealer_activity_for_dealer": activity_for_dealer,
        "dealer_profile_for_dealer": profile_for_dealer,
        "requests_latest_displayed": _shown(display.format_requests, _panel("all")),
        "recent_views_displayed": _shown(display.format_views, recent_views),
        "recent_filters_displayed": _shown(display.format_filters, recent_filters),
        "listing_match_displayed": _shown(display.format_listings, listing_match),
        "requests_latest_headed": _headed(display.REQUEST_HEADINGS, display.format_requests, _panel("all")),
        "recent_views_headed": _headed(display.VIEW_HEADINGS, display.format_views, recent_views),
        "recent_filters_headed": _headed(display.FILTER_HEADINGS, display.format_filters, recent_filters),
        "listing_match_headed": _headed(display.LISTING_HEADINGS, display.format_listings, listing_match),
    }
