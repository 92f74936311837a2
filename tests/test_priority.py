"""Attention priority: the golden table of reachable labels (substring rules)."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions.priority import CRITICAL, HIGH, LOW, MEDIUM, priority_columns

GOLDEN = [
    ("No Purchase", LOW, 3),
    ("No Purchase - 1 Time Purchaser", CRITICAL, 9),
    ("1 Time Purchaser - No Purchase", LOW, 0),
    ("No Purchase - Frequent (New)", HIGH, 8),
    ("No Purchase - Frequent (At Risk)", CRITICAL, 10),
    ("No Purchase - Active (New)", HIGH, 7),
    ("Frequent - No Purchase", CRITICAL, 3),
    ("Frequent - 1 Time Purchaser", HIGH, 5),
    ("Frequent - Frequent", MEDIUM, 4),
    ("Frequent - Frequent (At Risk)", CRITICAL, 2),
    ("Inactive - 1 Time Purchaser", MEDIUM, 11),
    ("Inactive - Frequent (New)", CRITICAL, 7),
    ("Inactive - Frequent (At Risk)", CRITICAL, 6),
    ("Inactive - Active (New)", HIGH, 6),
    ("Active - No Purchase", HIGH, 0),
    ("Active - 1 Time Purchaser", MEDIUM, 0),
    ("Active - Frequent (New)", HIGH, 1),
    ("Active - Frequent (At Risk)", CRITICAL, 1),
    ("Active - Active", MEDIUM, 1),
    ("Frequent - Active", HIGH, 3),
    ("No Purchase - Inactive", LOW, 1),
    ("Inactive - Inactive", MEDIUM, 9),
    ("Active - Inactive", HIGH, 2),
    ("Frequent - Inactive", HIGH, 4),
    ("Something else", LOW, 3),
]


def test_golden_table(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "current_segmentation string")
    out = df.withColumns(priority_columns("current_segmentation")).collect()
    got = {r.current_segmentation: (r.status, r.priority_score) for r in out}
    for label, status, score in GOLDEN:
        assert got[label] == (status, score), label


def test_rank_orders_statuses(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "current_segmentation string")
    rows = df.withColumns(priority_columns("current_segmentation")).collect()
    rank = {CRITICAL: 0, HIGH: 1, MEDIUM: 2, LOW: 3}
    assert all(r.priority_rank == rank[r.status] for r in rows)


def test_no_python_udf(spark):
    df = spark.createDataFrame([("x",)], "current_segmentation string")
    plan = df.withColumns(priority_columns("current_segmentation"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
