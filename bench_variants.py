"""

Usage: ``BENCH_SF_DIR=/root/testdata/sf0.1 python bench_variants.py``; prints one
JSON line of seconds per variant (one warm-up run, then the median of 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from lotwise.operators import listings, metrics  # noqa: E402
from lotwise.session import build_session  # noqa: E402
from lotwise.sources.fixtures import AS_OF, fixture_tables  # noqa: E402

# The reference's shape: one scan per window, per-event LAG gaps, COUNT(DISTINCT)
# over raw events, then one join per window back to the roster.
_NAIVE = """
WITH bn AS (
  SELECT dealer_code, CAST(wholesale_vehicle_sold_date AS DATE) AS pd,
         CAST(received_at AS DATE) AS rd
  FROM {requests} WHERE request_type = 'Buy Now'),
ev AS (
  SELECT dealer_code, 'pl' AS w, pd AS d FROM bn WHERE pd IS NOT NULL
  UNION ALL SELECT dealer_code, 'p6', pd FROM bn WHERE pd >= DATE '{a60}'
  UNION ALL SELECT dealer_code, 'pp', pd FROM bn WHERE pd BETWEEN DATE '{a120}' AND DATE '{a60}'
  UNION ALL SELECT dealer_code, 'rl', rd FROM bn
  UNION ALL SELECT dealer_code, 'r6', rd FROM bn WHERE rd >= DATE '{a60}'),
gaps AS (
  SELECT dealer_code, w, d,
         datediff(d, LAG(d) OVER (PARTITION BY dealer_code, w ORDER BY d)) AS gap FROM ev),
per_w AS (
  SELECT dealer_code, w, AVG(gap) AS avg_gap, COUNT(DISTINCT d) AS n_days,
         COUNT(DISTINCT trunc(d, 'MM')) AS n_months, MAX(d) AS last_d
  FROM gaps GROUP BY dealer_code, w)
SELECT r.dealer_code, r.dealer_name,
       pl.avg_gap, p6.avg_gap, pp.avg_gap, rl.avg_gap, r6.avg_gap,
       pl.n_days, p6.n_days, pp.n_days, rl.n_days, r6.n_days,
       round(pl.n_days / nullif(pl.n_months, 0), 2), round(rl.n_days / nullif(rl.n_months, 0), 2)
FROM (SELECT DISTINCT dealer_code, dealer_name FROM {dealers}) r
LEFT JOIN per_w pl ON pl.dealer_code = r.dealer_code AND pl.w = 'pl'
LEFT JOIN per_w p6 ON p6.dealer_code = r.dealer_code AND p6.w = 'p6'
LEFT JOIN per_w pp ON pp.dealer_code = r.dealer_code AND pp.w = 'pp'
LEFT JOIN per_w rl ON rl.dealer_code = r.dealer_code AND rl.w = 'rl'
LEFT JOIN per_w r6 ON r6.dealer_code = r.dealer_code AND r6.w = 'r6'
"""


def main() -> None:
    import datetime as dt
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 4)
    spark = build_session(f"local[{cpus}]", app_name="lotwise-variants",
                          shuffle_partitions=2 * cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "6g")})
    t = fixture_tables(spark, sf_dir)
    days = {f"a{n}": (AS_OF - dt.timedelta(days=n)).isoformat() for n in (60, 120)}

    def naive():
        return spark.sql(_NAIVE.replace("{a60}", days["a60"]).replace("{a120}", days["a120"]),
                         requests=t.requests, dealers=t.dealers)

    def one_pass_repartitioned():
        req = t.requests.repartition("dealer_code")
        return metrics.dealer_metrics(req, t.dealers, AS_OF)

    def telescoped():
        return metrics.purchase_intervals(t.requests, AS_OF)

    def lag_form():
        g = metrics.purchase_gaps(t.requests, AS_OF)
        return g.groupBy("dealer_code", "period").agg(
            F.sum("days_since_previous").alias("s"), F.sum("n_purchases").alias("n"))

    def match(hint):
        dims = t.dim_dealers.hint(hint)
        return listings.listing_match(t.listings, dims, AS_OF, ordered=False)

    variants = {
        "dealer_metrics.reference_shape_sql": naive,
        "dealer_metrics.one_pass": lambda: metrics.dealer_metrics(t.requests, t.dealers, AS_OF),
        "dealer_metrics.one_pass_repartitioned": one_pass_repartitioned,
        "purchase_intervals.telescoped": telescoped,
        "purchase_intervals.lag_per_day": lag_form,
        "listing_match.broadcast": lambda: match("broadcast"),
        "listing_match.shuffle": lambda: match("shuffle_hash"),
    }
    out = {}
    for name, build in variants.items():
        def run():
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start
        run()
        out[name] = round(statistics.median(run() for _ in range(3)), 3)
    print(json.dumps({"sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": cpus,
                      "variants_sec": out}))
    spark.stop()


if __name__ == "__main__":
    main()
