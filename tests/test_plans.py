"""Physical plans of all registered queries: no pair-everything joins, pruned scans."""

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tarnfield.plans import QUERIES
from tarnfield.plans import adapters as A
from tarnfield.operators import summary

FOLDER = "/root/testdata/sf0.001"
ACTIONS = ("checkpoint", "first", "collect", "count", "isEmpty")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Every plan that an operator runs on its way, and the one it returns."""
    seen = []
    for name in ACTIONS:
        original = getattr(DataFrame, name)

        def watched(self, *args, _original=original, **kwargs):
            seen.append(plan_of(self))
            return _original(self, *args, **kwargs)

        monkeypatch.setattr(DataFrame, name, watched)
    return seen


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.endswith("_stream")))
def test_no_pairwise_joins(spark, plans, name):
    plans.append(plan_of(QUERIES[name](spark, FOLDER)))
    for plan in plans:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_cube_scan_reads_its_columns_only(spark):
    plan = plan_of(A.frames(spark, FOLDER).groupBy("t").agg({"h": "max"}))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>", plan) or "event_id" not in plan.split("ReadSchema")[1]
    assert "props" not in plan.split("ReadSchema")[1]


def test_cell_summary_aggregates_before_the_join(spark):
    plan = plan_of(summary.cell_summary(A.frames(spark, FOLDER), A.frame_cells(spark, FOLDER)))
    join = plan.index("Join")
    assert plan.index("Aggregate", join) > join
