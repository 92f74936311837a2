"""A stored state of the request fact, from which lifetime metrics need no rescan.

Every cadence metric is a function of how many Buy Now events fell on each
(dealer, kind, day) (``metrics.buy_now_day_counts``).  Those counts merge by
addition, so they are kept as a table of batches under ``<root>/batch=<id>/``: a
day's new requests add one batch, whose size is that day's, and a metric run reads
the counts instead of the fact.

A request that changes (it is sold later) is a new row in ``added`` and its former
row in ``removed``, which counts as minus one.  Writing a batch again replaces it,
so a repeated or recovered job counts nothing twice.  ``compact`` folds all batches
into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.metrics import buy_now_day_counts, metrics_from_days, metrics_of_roster
from lotwise.session import materialize

STATE_SCHEMA = "dealer_code string, kind string, d date, n long"
KEYS = ("dealer_code", "kind", "d")


def _merged(counts: DataFrame) -> DataFrame:
    """One row per dealer, kind and day; days whose events all went are no days."""
    return counts.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


class CadenceState:
    """Day counts of Buy Now events, stored in batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, counts: DataFrame, batch: str, mode: str) -> None:
        (counts.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", mode)
         .partitionBy("batch").parquet(self.root))

    def fold(self, batch: str, added: DataFrame, removed: DataFrame | None = None) -> None:
        """Store the counts of a batch of requests; the same ``batch`` again replaces it."""
        counts = buy_now_day_counts(added)
        if removed is not None:
            counts = counts.unionByName(buy_now_day_counts(removed).withColumn("n", -F.col("n")))
        self._write(_merged(counts), batch, "dynamic")

    def days(self) -> DataFrame:
        """(dealer_code, kind, d, n) over all batches."""
        stored = self.spark.read.schema(f"{STATE_SCHEMA}, batch string").parquet(self.root)
        return _merged(stored.drop("batch"))

    def compact(self, batch: str) -> None:
        """Replace all batches by one; what is read is written aside first."""
        self._write(materialize(self.days(), "cadence"), batch, "static")

    def dealer_metrics(self, dealers: DataFrame, as_of) -> DataFrame:
        """The same rows as ``metrics.dealer_metrics`` over all requests folded so far."""
        return metrics_of_roster(metrics_from_days(self.days(), as_of), dealers)
