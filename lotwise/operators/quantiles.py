"""Exact percentiles (linear interpolation) and moments with bounded per-task memory.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so a group holding a third of the data would have to fit
in one task.  Here the input is reduced once, map-side first, to one row per
(group, value) with its count; everything else reads that exchange:

1. each group's histogram: per narrow band of the value's logarithm the count,
   extremes and sums around the band's centre.  It merges like any aggregate and
   has at most one row per group and band;
2. running counts over it tell in which band each wanted rank lies; its sums give
   count, mean, extremes and deviation, weighted by the counts;
3. the values of the wanted bands alone are ranked, by (group, band);
4. the two neighbouring order statistics ``a = x[f]`` and ``b = x[f + 1]``
   (``h = (n - 1) * p``, ``f = floor(h)``, ``t = h - f``) are interpolated bit
   for bit as numpy does: ``a + (b - a) * t`` when ``t < 0.5``, else
   ``b - (b - a) * (1 - t)``.

A window therefore sees a group's bands, or the distinct values of one of them,
never a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

KINDS = ("n", "mean", "min", "max", "std")
BANDS = 256           # buckets per unit of the natural logarithm


def lerp(a, b, t):
    """numpy's linear interpolation (exact at both ends)."""
    diff = b - a
    return F.when(t >= 0.5, b - diff * (F.lit(1.0) - t)).otherwise(a + diff * t)


def bucket(v: Column, bands: int = BANDS) -> Column:
    """A whole number that never falls as ``v`` rises; NULL for NULL."""
    band = F.floor(F.log1p(F.abs(v)) * F.lit(bands))
    return F.when(v >= 0, band).otherwise(-band - 1)


def centre(b: Column, bands: int = BANDS) -> Column:
    """A value inside bucket ``b``."""
    inside = F.expm1((F.when(b >= 0, b).otherwise(-b - 1) + F.lit(0.5)) / F.lit(bands))
    return F.when(b >= 0, inside).otherwise(-inside)


def _histograms(counted: DataFrame, bands: int) -> DataFrame:
    """One row per (group ``g``, band ``b``): its count and extremes, and the group's moments.

    The windows run over the bands of a group.
    """
    v, c = F.col("v"), F.col("c")
    # No filter on the value: it would be pushed below the reduction in some
    # branches only, and they would no longer share its exchange.
    off = v - centre(bucket(v, bands), bands)
    per_band = counted.groupBy("g", bucket(v, bands).alias("b")).agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), c)), F.lit(0)).alias("c"), F.min("v").alias("lo"),
        F.max("v").alias("hi"), F.sum(off * c).alias("d"), F.sum(off * off * c).alias("q"), F.sum(v * c).alias("s"))
    group = Window.partitionBy("g")
    upto = group.orderBy(F.col("b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = per_band.withColumns({"before": F.sum("c").over(upto) - c, "n": F.sum("c").over(group),
                                 "total": F.sum("s").over(group), "min": F.min("lo").over(group),
                                 "max": F.max("hi").over(group)})
    n, mean = F.col("n"), F.col("mean")
    away = centre(F.col("b"), bands) - mean
    squares = F.sum(F.col("q") + F.lit(2.0) * away * F.col("d") + c * away * away).over(group)
    return held.withColumn("mean", F.col("total") / F.nullif(n, F.lit(0))).select(
        "g", "b", "c", "lo", "hi", "before", "n", "mean", "min", "max",
        F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1))).alias("std"))


def _wanted(histograms: DataFrame, probs: dict[str, float]) -> DataFrame:
    """The bands that hold a wanted rank, with ``wants``, the ranks inside the band.

    A group without values keeps its one row.
    """
    ranks = []
    for name, p in probs.items():
        low = F.floor((F.col("n") - 1) * F.lit(float(p)))
        for side, rank in (("a", low), ("b", F.least(low + 1, F.col("n") - 1))):
            ranks.append((f"{name}|{side}", rank - F.col("before")))
    inside = lambda r: (r >= 0) & (r < F.col("c"))
    some = reduce(lambda x, y: x | y, [inside(r) for _, r in ranks])
    wants = F.array(*[F.when(inside(r), F.struct(F.lit(q).alias("q"), r.alias("r"))) for q, r in ranks])
    return histograms.where(some | (F.col("n") == 0)).withColumn("wants", F.array_compact(wants))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      moments: dict[str, str] | None = None, bands: int = BANDS) -> DataFrame:
    """One row per group of ``df``: ``keys``, one column per entry of ``probs`` and of ``moments``.

    ``moments`` maps names to ``n``, ``mean``, ``min``, ``max`` or ``std`` (the sample
    deviation).  NULL values are ignored; a group with no values gets NULL
    percentiles.  NULL keys form their own group: groups are compared as structs.
    """
    counted = (df.select(F.struct(*keys).alias("g"), F.col(value).cast("double").alias("v"))
               .groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")))
    wanted = _wanted(_histograms(counted, bands), probs)
    # never NULL, so that no filter comes between this branch and the shared exchange
    band = F.coalesce(bucket(F.col("v"), bands), F.lit(-(1 << 62)))
    values = counted.select(F.col("g").alias("v_g"), band.alias("v_b"), "v", F.col("c").alias("v_c"))
    # a band of one value answers by itself
    inside = Window.partitionBy("g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (wanted.join(values, (F.col("g") == F.col("v_g")) & (F.col("b") == F.col("v_b"))
                          & (F.col("lo") < F.col("hi")), "left").withColumn("upto", F.sum("v_c").over(inside)))
    hits = F.filter("wants", lambda w: F.col("v").isNull() | (
        (w["r"] < F.col("upto")) & (w["r"] >= F.col("upto") - F.col("v_c"))))
    found = ranked.select("g", *KINDS, F.coalesce("v", "lo").alias("value"),
                          F.explode_outer(F.transform(hits, lambda w: w["q"])).alias("q"))
    out = found.groupBy("g").agg(*[F.max(kind).alias(kind) for kind in KINDS], *[
        F.max(F.when(F.col("q") == F.lit(f"{name}|{side}"), F.col("value"))).alias(f"{name}|{side}")
        for name in probs for side in "ab"])
    h = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    return out.select(
        *[F.col(f"g.{k}").alias(k) for k in keys],
        *[lerp(F.col(f"{x}|a"), F.col(f"{x}|b"), h[x] - F.floor(h[x])).alias(x) for x in probs],
        *[F.col(kind).alias(name) for name, kind in (moments or {}).items()])
