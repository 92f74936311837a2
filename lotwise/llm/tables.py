"""Table access and lineage cuts shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.session import materialize, scratch

__all__ = ["cut", "scratch", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame reading it.

    Used where several branches need the same intermediate: it is computed
    once, is columnar, and survives lost executors.  ``session.clear_scratch``
    deletes what an application wrote.
    """
    return materialize(df, name)
