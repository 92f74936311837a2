"""A dealer given as an argument reaches every scan that can use it."""

import os
import re

import pytest

from lotwise.plans.registry import queries
from lotwise.session import checkpoint_dir
from lotwise.sources.schemas import conform

from conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="fixture data missing")


def scans(df, table):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if f"{table}.parquet" in line]


@pytest.mark.parametrize("key", ["purchase_history_for_dealer", "price_stats_for_dealer",
                                 "purchase_timeline_for_dealer"])
def test_name_is_pushed_to_every_customer_scan(spark, key):
    found = scans(queries()[key](spark, SMALL), "customer")
    assert found and all("EqualTo(c_name,Customer#000000001)" in line for line in found)


def test_code_is_filtered_at_every_scan(spark):
    found = scans(queries()["dealer_segmentation_for_dealer"](spark, SMALL), "customer")
    assert found and all(re.search(r"cast\(c_custkey#\d+L? as string\) = 1", line) for line in found)
    found = scans(queries()["dealer_activity_for_dealer"](spark, SMALL), "events")
    assert found and all(re.search(r"cast\(user_id#\d+L? as string\) = 1", line) for line in found)


def test_profile_and_recommendation_filter_every_customer_scan(spark):
    for key in ("dealer_profile_for_dealer", "recommend_for_dealer"):
        found = [line for line in scans(queries()[key](spark, SMALL), "customer") if "c_name" in line]
        own = [line for line in found if "Customer#000000001" in line
               or re.search(r"cast\(c_custkey#\d+L? as string\) = 1", line)]
        assert found and len(own) == len(found), key


def test_one_dealer_equals_the_filtered_whole(spark):
    whole = queries()["purchase_history"](spark, SMALL).where("dealer_name = 'Customer#000000001'")
    one = queries()["purchase_history_for_dealer"](spark, SMALL)
    assert one.count() > 0
    assert sorted(map(repr, one.collect())) == sorted(map(repr, whole.collect()))


def test_a_contract_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="dealers lacks the columns dealer_name"):
        conform(spark.createDataFrame([("1",)], "dealer_code string"), "dealers")
    frame = conform(spark.createDataFrame([("n", 1, True)], "dealer_name string, dealer_code int, more boolean"),
                    "dealers")
    assert frame.dtypes == [("dealer_code", "string"), ("dealer_name", "string")]


def test_a_cluster_must_name_its_checkpoint_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
