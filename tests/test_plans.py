"""Physical plans: no cross joins, no single-task windows over rows, pushed filters, pruned columns."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "stg_invoices", "fct_orders", "dim_products", "snapshot_dates", "churn_feature_panel", "rfm_segments",
    "latest_snapshot", "candidate_products", "candidate_products_fallback", "validated_offers", "first_valid_attempt",
    "roc_auc", "calibration_table", "risk_bands", "interventions", "dashboard_predictions",
]


def plan_of(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("roc_auc", "rfm_segments", "dashboard_predictions", "interventions")])
def test_no_window_without_partition(spark, name):
    # the others have one over their range parts: one row each
    assert not re.search(r"windowspecdefinition\(\S+ (ASC|DESC)", plan_of(spark, name))


def test_panel_expands_after_its_only_wide_shuffle(spark):
    plan = plan_of(spark, "churn_feature_panel")
    # from the top: the grouping, the expansion and then the shuffle by customer alone
    top = plan[: plan.index("REPARTITION_BY_COL")]
    assert "Generate explode" in top and "ENSURE_REQUIREMENTS" not in top
    assert "SortMergeJoin" not in plan


def test_top_products_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "candidate_products")


def test_columns_are_pruned(spark):
    plan = plan_of(spark, "dim_customers")
    lineitem = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    schema = lineitem[lineitem.index("ReadSchema") :]
    assert "l_tax" not in schema and "l_shipdate" not in schema and "l_suppkey" not in schema


@pytest.mark.parametrize("name", ["latest_snapshot", "churn_feature_panel", "snapshot_dates"])
def test_rows_are_not_sorted_for_an_aggregate(spark, name):
    assert "SortAggregate" not in plan_of(spark, name)


def test_lines_are_shuffled_once(spark):
    plan = plan_of(spark, "fct_orders")
    # the only sort-based aggregate is over the few rows per invoice and country
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning(invoice_no" in x]
    assert len(lines) == 1 and "REPARTITION_BY_COL" in lines[0]
