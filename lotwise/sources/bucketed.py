"""Contract tables stored in buckets of their join and filter keys.

The request facts are bucketed by dealer code, so a query for one dealer reads one
bucket of each; the two vehicle tables are bucketed by vehicle, so the purchase
history joins them where they lie and moves the sales alone.  Buckets are Spark's
own bucketed tables: the operators are unchanged, the planner does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.sources.schemas import CONTRACTS, conform

#: The bucket column of each table; tables not named here are small or scanned whole.
BUCKET_COLUMNS = {
    "requests": "dealer_code",
    "dealers_activity": "dealer_code",
    "view_events": "entity_code",
    "filter_events": "entity_code",
    "dealers": "dealer_code",
    "dim_dealers": "dealer_code",
    "vehicle_history": "vehicle_id",
    "publishing_logs": "vehicle_id",
}


def write_bucketed(df: DataFrame, table: str, name: str, path: str, buckets: int) -> None:
    """Store contract table ``name`` as the catalog table ``table`` at ``path``.

    One shuffle by the bucket column first, so that a bucket is one sorted file.
    """
    column = BUCKET_COLUMNS[name]
    (conform(df, name).repartition(buckets, column).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, column).sortBy(column).saveAsTable(table))


class BucketedTables:
    """Contract tables, read from buckets where stored and from ``others`` where not.

    ``buckets`` should be at least the number of shuffle partitions: Spark joins a
    bucketed side in place only if that keeps enough tasks busy.
    """

    def __init__(self, spark: SparkSession, prefix: str, root: str, buckets: int, others=None):
        self.spark, self.prefix, self.root, self.buckets, self.others = spark, prefix, root.rstrip("/"), buckets, others

    def store(self, tables, names=tuple(BUCKET_COLUMNS)) -> None:
        """Write the named attributes of ``tables``."""
        for name in names:
            write_bucketed(getattr(tables, name), f"{self.prefix}_{name}", name, f"{self.root}/{name}", self.buckets)

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for name in BUCKET_COLUMNS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in CONTRACTS:
            raise AttributeError(name)
        if name in BUCKET_COLUMNS and self.spark.catalog.tableExists(f"{self.prefix}_{name}"):
            return self.spark.table(f"{self.prefix}_{name}")
        return getattr(self.others, name)
