"""The stored day counts give the metrics of the whole fact."""

import random

from lotwise.operators import metrics
from lotwise.sources.cadence import CadenceState
from lotwise.sources.schemas import DEALERS

from helpers import AS_OF, day, requests_frame


def _random_rows(n, seed):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        sold = rnd.choice([None, rnd.randint(0, 200)])
        rows.append({"request_id": f"q{i}", "dealer_code": rnd.choice(["a", "b", "c", None]),
                     "request_type": rnd.choice(["Buy Now", "Buy Now", "Visit"]), "received_at": day(rnd.randint(0, 200)),
                     "wholesale_vehicle_sold_date": None if sold is None else day(sold)})
    return rows


def _same(spark, state, rows, dealers):
    want = metrics.dealer_metrics(requests_frame(spark, rows), dealers, AS_OF)
    got = state.dealer_metrics(dealers, AS_OF)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_state_plus_a_day_equals_the_full_run(spark, tmp_path):
    dealers = spark.createDataFrame([(c, f"D{c}") for c in "abcd"], DEALERS)
    rows = _random_rows(300, 1)
    state = CadenceState(spark, str(tmp_path / "state"))
    state.fold("before", requests_frame(spark, rows[:250]))
    _same(spark, state, rows[:250], dealers)
    state.fold("day", requests_frame(spark, rows[250:]))
    state.fold("day", requests_frame(spark, rows[250:]))      # a repeated job counts once
    _same(spark, state, rows, dealers)
    state.compact("all")
    _same(spark, state, rows, dealers)
    assert state.spark.read.parquet(state.root).select("batch").distinct().count() == 1


def test_a_changed_request_replaces_its_former_row(spark, tmp_path):
    dealers = spark.createDataFrame([(c, f"D{c}") for c in "abc"], DEALERS)
    rows = _random_rows(120, 2)
    former = [r for r in rows if r["wholesale_vehicle_sold_date"] is None][:10]
    changed = [{**r, "wholesale_vehicle_sold_date": day(3)} for r in former]
    state = CadenceState(spark, str(tmp_path / "state"))
    state.fold("before", requests_frame(spark, rows))
    state.fold("sold", requests_frame(spark, changed), requests_frame(spark, former))
    ids = {r["request_id"] for r in former}
    _same(spark, state, [r for r in rows if r["request_id"] not in ids] + changed, dealers)
    state.fold("gone", requests_frame(spark, []), requests_frame(spark, changed))
    _same(spark, state, [r for r in rows if r["request_id"] not in ids], dealers)


def test_metrics_from_the_state_do_not_read_the_fact(spark, tmp_path):
    state = CadenceState(spark, str(tmp_path / "state"))
    state.fold("all", requests_frame(spark, _random_rows(20, 3)))
    plan = state.dealer_metrics(spark.createDataFrame([], DEALERS), AS_OF)._jdf.queryExecution().toString()
    assert "received_at" not in plan and "request_type" not in plan
