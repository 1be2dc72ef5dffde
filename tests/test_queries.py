import re

import pytest

import oracle_check
from supportlens.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_check.oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, connection, name):
    query = catalog.QUERIES[name]
    difference = oracle_check.compare(spark, connection, query, catalog.ORACLES.get(name), SF_DIR)
    # The smallest tables hold no orphans.
    assert difference == ("both empty" if name == "feedback_orphans" else "")


UNBOUNDED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
PLANNED = [
    "pair_turns", "conversation_analytics", "feedback_with_conversation", "confusion_matrix",
    "histogram", "kde_curve", "vector_topk", "vector_topk_filtered", "value_shares", "class_report",
]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_nested_loops_and_no_row_wise_python(spark, name):
    frame = catalog.QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in UNBOUNDED if word in plan]


def test_scans_read_only_needed_columns(spark):
    plan = catalog.QUERIES["hourly_distribution"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<ts:timestamp_ntz>"]


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_user_turns"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in plan


@pytest.mark.parametrize("name", ["examples_per_category", "vector_topk", "top_terms_per_cluster"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    plan = catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning(?s:.)*WindowGroupLimit .*Partial", plan)


@pytest.mark.parametrize("name", ["last_user_message", "dedupe_keep_first", "average_rating"])
def test_copies_collapse_before_the_shuffle(spark, name):
    plan = catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning(?s:.)*partial_m(ax|in)_by", plan)


def test_totals_are_subqueries_not_joins(spark):
    plan = catalog.QUERIES["value_shares"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "Join" not in plan


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
