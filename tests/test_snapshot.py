"""Snapshots: committed versions per day, freshness, pruned reads."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lotwise.plans.registry import queries
from lotwise.sources import snapshot as S
from lotwise.sources.fixtures import AS_OF

from conftest import SMALL

DAY, NEXT = dt.date(2001, 8, 1), dt.date(2001, 8, 2)
NOON = dt.datetime(2024, 1, 1, 12)


def frames(spark, n):
    return {"a": spark.range(n).withColumn("x", F.lit("t")), "b": spark.range(0).withColumn("y", F.lit(1.5))}


def test_versions_of_a_day_and_empty_results(spark, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(LookupError):
        S.read_snapshot(spark, root, "a", DAY)
    S.write_snapshot(frames(spark, 3), root, DAY, NOON)
    S.write_snapshot(frames(spark, 4), root, NEXT, NOON)
    held = S.read_snapshot(spark, root, "a", DAY)
    S.write_snapshot(frames(spark, 5), root, DAY, NOON + dt.timedelta(hours=1))
    assert held.count() == 3                     # an open reader keeps its version
    assert S.read_snapshot(spark, root, "a", DAY).count() == 5
    assert S.read_snapshot(spark, root, "a", NEXT).count() == 4
    empty = S.read_snapshot(spark, root, "b", DAY)
    assert empty.columns == ["id", "y"] and empty.collect() == []
    rows = {(r.as_of, r.name): r.n_rows for r in S.manifest(spark, root).collect()}
    assert rows == {(DAY, "a"): 5, (DAY, "b"): 0, (NEXT, "a"): 4, (NEXT, "b"): 0}


def test_what_the_manifest_does_not_name_is_not_read(spark, tmp_path):
    root = str(tmp_path / "s")
    S.write_snapshot(frames(spark, 3), root, DAY, NOON)
    spark.range(9).withColumns({"x": F.lit("u"), "as_of": F.lit(DAY), "version": F.lit("failed")}) \
        .write.mode("append").partitionBy(*S.PARTITIONS).parquet(f"{root}/a")
    assert S.read_snapshot(spark, root, "a", DAY).count() == 3


def test_fresh_versions_are_served_and_stale_ones_replaced(spark, tmp_path):
    root = str(tmp_path / "s")
    assert S.snapshot(frames(spark, 3), root, DAY, NOON)["a"].count() == 3
    almost, over = NOON + S.MAX_AGE - dt.timedelta(seconds=1), NOON + S.MAX_AGE
    assert S.snapshot(frames(spark, 7), root, DAY, almost)["a"].count() == 3
    assert S.read_snapshot(spark, root, "a", DAY, now=almost).count() == 3
    with pytest.raises(LookupError):
        S.read_snapshot(spark, root, "a", DAY, now=over)
    assert S.snapshot(frames(spark, 7), root, DAY, over)["a"].count() == 7


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="fixture data missing")
def test_read_back_prunes_to_one_version(spark):
    plan = queries()["snapshot_live_inventory"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scan) == 1 and "part.parquet" not in plan
    filters = scan[0].split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "as_of#" in filters and str(AS_OF) in filters and "version#" in filters
