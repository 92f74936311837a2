"""Property tests against brute force in plain Python."""

import math
import random

import numpy as np
import pytest

from lotwise.operators import recommend
from lotwise.operators.quantiles import exact_percentiles


def _brute_top(history, live, k):
    """The dashboard's scoring loop, for every dealer, top k by (score, name)."""
    out = {}
    for dealer in sorted({h[0] for h in history}):
        rows = [h for h in history if h[0] == dealer]
        n = len(rows)
        makes = {}
        for _, mk, md, y, km in rows:
            if mk is not None:
                makes.setdefault(mk, []).append(md)
        years = [r[3] for r in rows if r[3] is not None]
        kms = [r[4] for r in rows if r[4] is not None]

        def stats(v):
            if not v:
                return None, None
            m = sum(v) / len(v)
            s = math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None
            return m, s

        (ym, ys), (km_m, km_s) = stats(years), stats(kms)

        def rng(x, m, s):
            if s is None or not s > 0 or x is None:
                return 0.0
            return min(2.0, max(0.0, 2 - abs(x - m) / s))

        scored = []
        for name, mk, md, y, km in live:
            ms = len(makes[mk]) / n * 3 if mk in makes else 0.0
            mds = 0.0
            if mk in makes and md is not None and md in makes[mk]:
                mds = makes[mk].count(md) / len(makes[mk]) * 2
            scored.append((-(ms + mds + rng(y, ym, ys) + rng(km, km_m, km_s)), name))
        out[dealer] = [(round(-s, 9), nm) for s, nm in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recommend_top_k_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    makes, models = ["A", "B", "C", None], ["x", "y", None]
    history = []
    for d in range(25):
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            history.append((f"d{d}", rnd.choice(makes), rnd.choice(models),
                            rnd.choice([None, 2010.0, 2012.0, 2015.0, 2018.0]),
                            rnd.choice([None, 0.0, 30000.0, 80000.0, 150000.0, 210000.0])))
    live = []
    for c in range(70):
        live.append((f"car{c:03d}", rnd.choice(makes), rnd.choice(models),
                     rnd.choice([None, 2010.0, 2011.0, 2015.0, 2019.0]),
                     rnd.choice([None, 5000.0, 40000.0, 90000.0, 120000.0, 250000.0])))
    h = spark.createDataFrame(history, "dealer_name string, make string, model string, "
                                       "year double, kilometers double")
    lv = spark.createDataFrame(live, "sf_vehicle_name string, make string, model string, "
                                     "year double, kilometers double")
    k = 5
    got = {}
    for r in recommend.recommend_cars(h, lv, top_k=k).collect():
        got.setdefault(r.dealer_name, []).append((r.rank, round(r.match_score, 9),
                                                  r.sf_vehicle_name))
    want = _brute_top(history, live, k)
    assert set(got) == set(want)
    for dealer, rows in got.items():
        assert [(s, n) for _, s, n in sorted(rows)] == want[dealer], dealer


def _frames(spark, history, live):
    return (spark.createDataFrame(history, "dealer_name string, make string, model string, "
                                           "year double, kilometers double"),
            spark.createDataFrame(live, "sf_vehicle_name string, make string, model string, "
                                        "year double, kilometers double"))


def test_recommend_with_hundreds_of_mileages_per_cell(spark):
    """Year cells of far more than k cars and mileages, popular ones too."""
    rnd = random.Random(11)
    makes, models = ["A", "B", "C"], ["x", "y"]
    years = [2008.0, 2012.0, 2013.0, 2019.0]
    history = [(f"d{d}", rnd.choice(makes), rnd.choice(models), rnd.choice(years),
                float(rnd.randint(0, 220000))) for d in range(12) for _ in range(rnd.choice([1, 3, 9]))]
    live = [(f"car{c:05d}", rnd.choice([*makes, "D", None]), rnd.choice([*models, None]),
             rnd.choice([*years, None, 1800.0]),
             rnd.choice([float(rnd.randint(0, 220000)), float(rnd.randint(0, 20) * 10000), None, -5.0, 9e6]))
            for c in range(4000)]
    h, lv = _frames(spark, history, live)
    k = 10
    got = {}
    for r in recommend.recommend_cars(h, lv, top_k=k).collect():
        got.setdefault(r.dealer_name, []).append((r.rank, round(r.match_score, 9), r.sf_vehicle_name))
    want = _brute_top(history, live, k)
    assert {d: [(s, n) for _, s, n in sorted(rows)] for d, rows in got.items()} == want


def test_full_ranking_for_one_dealer(spark):
    rnd = random.Random(5)
    history = [(f"d{d}", rnd.choice(["A", "B", None]), rnd.choice(["x", None]), rnd.choice([None, 2010.0, 2015.0]),
                rnd.choice([None, 1000.0, 90000.0])) for d in range(4) for _ in range(6)]
    live = [(f"car{c:03d}", rnd.choice(["A", "B", None]), rnd.choice(["x", "z", None]),
             rnd.choice([None, 2011.0, 2015.0]), rnd.choice([None, 500.0, 80000.0])) for c in range(50)]
    h, lv = _frames(spark, history, live)
    want = _brute_top(history, live, len(live))
    for dealer in ("d0", "d3"):
        rows = recommend.recommend_for_dealer(h, lv, dealer).collect()
        assert sorted((-round(r.match_score, 9), r.sf_vehicle_name) for r in rows) == sorted(
            (-s, n) for s, n in want[dealer])
        assert [r.match_score for r in rows] == sorted((r.match_score for r in rows), reverse=True)
    assert recommend.recommend_for_dealer(h, lv, "nobody").collect() == []


def test_cells_are_not_joined_text(spark):
    """make 'a|b' + model 'c' is not make 'a' + model 'b|c'."""
    history = [("d", "a", "b|c", 2010.0, 10000.0), ("d", "a", "b|c", 2010.0, 12000.0)]
    live = [(f"r{i}", "a", "b|c", 2010.0, 90000.0) for i in range(4)]
    live += [(f"s{i}", "a|b", "c", 2010.0, 11000.0 + i) for i in range(6)]
    h, lv = _frames(spark, history, live)
    got = recommend.recommend_cars(h, lv, top_k=2).orderBy("rank").collect()
    assert [(r.make, r.match_score) for r in got] == [("a", 5.0), ("a", 5.0)]


def test_windows_by_cell_see_bucket_sizes_alone(spark):
    """In the index's plan a window over a cell reads an aggregate by (cell, bucket)."""
    import re
    cars = spark.range(50).selectExpr("cast(id as string) sf_vehicle_name", "'A' make", "'x' model",
                                      "2010d year", "cast(id * 300 as double) kilometers", "1L copies")
    plans = []
    held, recommend.materialize = recommend.materialize, lambda df: plans.append(df) or df
    try:
        recommend._CellIndex(cars, 3)
    finally:
        recommend.materialize = held
    lines = plans[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    alone = [i for i, line in enumerate(lines) if re.search(r"windowspecdefinition\(cell#\d+, (specified|\w+#\w+ ASC)", line)]
    assert alone
    for i in alone:
        below = next(line for line in lines[i + 1:] if "Window" not in line and "Project" not in line)
        assert re.search(r"Aggregate \[cell#\d+, bucket#\d+L?\]", below), below


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 64, 100])
def test_binary_search_counts_values(spark, size):
    from pyspark.sql import functions as F
    values = sorted(random.Random(size).choices(range(20), k=size))
    frame = spark.range(-1, 22).select(F.col("id").cast("double").alias("x"),
                                       F.lit([float(v) for v in values]).cast("array<double>").alias("v"))
    for r in frame.withColumn("n", recommend._upper_bound(F.col("v"), F.col("x"))).collect():
        assert r.n == sum(v <= r.x for v in values)


def test_scores_are_bounded(spark):
    h = spark.createDataFrame([("d", "A", "x", 2010.0, 1000.0), ("d", "A", "x", 2012.0, 3000.0)],
                              "dealer_name string, make string, model string, year double, "
                              "kilometers double")
    lv = spark.createDataFrame([("c", "A", "x", 2011.0, 2000.0)],
                               "sf_vehicle_name string, make string, model string, "
                               "year double, kilometers double")
    row = recommend.recommend_cars(h, lv, top_k=3).first()
    assert row.match_score == 9.0
    assert row.score_breakdown == "Make: 3.0, Model: 2.0, Year: 2.0, Mileage: 2.0"


def _np_quantile(values, p):
    return float(np.quantile(np.array(values, dtype=float), p)) if values else None


def test_exact_percentiles_match_numpy(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(12):
        for _ in range(rnd.choice([1, 2, 3, 7, 40])):
            rows.append((f"g{g}" if g else None, rnd.choice([None, rnd.uniform(0, 1e5),
                                                             float(rnd.randint(0, 5))])))
    # one large group, negative values, and heavy ties
    rows += [("neg", rnd.uniform(-50, 50)) for _ in range(300)] + [("neg", -0.0), ("neg", 0.0)]
    rows += [("big", float(rnd.randint(0, 3000)) + rnd.random()) for _ in range(25000)]
    rows += [("big", 7.0)] * 3000                     # heavy ties inside the group
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    for k, vals in groups.items():
        vals = [v for v in vals if v is not None]
        for name, p in probs.items():
            want, have = _np_quantile(vals, p), getattr(got[k], name)
            assert (want is None and have is None) or have == want, (k, name, have, want)


def test_percentiles_do_not_depend_on_the_bands(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), rnd.choice([None, rnd.gauss(0, 1e4), 5.0])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.25, "median": 0.5}
    one = sorted(exact_percentiles(df, ["k"], "v", probs, bands=1).collect())
    assert one == sorted(exact_percentiles(df, ["k"], "v", probs, bands=5000).collect())


def test_percentiles_read_the_input_once(spark):
    import os
    from lotwise.plans.registry import queries
    from conftest import SMALL
    if not os.path.isdir(SMALL):
        pytest.skip("fixture data missing")
    df = queries()["price_stats"](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("lineitem.parquet") == 1


def test_shares_sum_to_100_and_scores_bounded(spark):
    import os
    from lotwise.plans.registry import queries
    from conftest import SMALL
    if not os.path.isdir(SMALL):
        pytest.skip("fixture data missing")
    q = queries()
    for key in ("make_distribution", "model_distribution", "mileage_histogram"):
        totals = q[key](spark, SMALL).groupBy("dealer_name").sum("share_pct").collect()
        assert totals and all(t[1] is None or abs(t[1] - 100.0) < 1e-9 for t in totals), key
    scores = [r.match_score for r in q["recommend_cars"](spark, SMALL).collect()]
    assert scores and all(0.0 <= s <= 9.0 for s in scores)


def test_first_round_scores_need_no_cars(spark):
    """At most k scores per query, each reached by a car of its own, and only mileages are read."""
    from pyspark.sql import functions as F
    rng = random.Random(5)
    kms = [None] + [float(rng.randrange(0, 40)) * 250 for _ in range(80)]
    cars = spark.createDataFrame([(f"c{i}", "A", "x", 2010.0, km, 1) for i, km in enumerate(kms)],
                                 "sf_vehicle_name string, make string, model string, year double, "
                                 "kilometers double, copies long")
    index = recommend._CellIndex(cars, 4)
    asked = [("near", 5000.0, 900.0), ("below", -9000.0, 6000.0), ("above", 99000.0, 50.0), ("one", 5000.0, None),
             ("none", None, None)]
    queries = spark.createDataFrame(asked, "dealer_name string, km_mean double, km_std double").select(
        "dealer_name", recommend._cell(1, year=F.lit(2010.0)).alias("cell"), "km_mean", "km_std",
        F.lit(0.5).alias("make_score"), F.lit(0.25).alias("model_score"), F.lit(1.0).alias("year_score"))
    plan = index.attained(queries, "dealer_name")
    assert "items" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.dealer_name: r.scores for r in plan.collect()}
    assert set(got) == {name for name, _, _ in asked}
    for name, mean, std in asked:
        best = sorted((1.75 + (max(0.0, 2 - abs(km - mean) / std) if std else 0.0)
                       for km in set(kms) if km is not None), reverse=True)
        assert 0 < len(got[name]) <= 4 and got[name] == sorted(got[name], reverse=True)
        assert all(g <= b + 1e-12 for g, b in zip(got[name], best)), name
    assert got["one"] == got["none"] == [1.75] * 4
