"""Stored lines keep their partitioning, and what several tables need is computed once."""

from __future__ import annotations

import pytest

import registered_queries
from patronlens.operators import core, marts, offers
from patronlens.sources import bindings
from patronlens.sources.storage import stash

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def stored(spark):
    return registered_queries._warehouse(spark, FOLDER, store_lines=True)


def test_totals_of_stored_lines_need_no_shuffle(spark, stored):
    totals = core.invoice_totals(stored.fct_order_lines)
    assert "Exchange" not in plan_of(totals)
    plain = registered_queries._warehouse(spark, FOLDER)
    assert same(stored.stg_invoices, plain.stg_invoices) and same(totals, core.invoice_totals(plain.fct_order_lines))


def test_customers_and_order_figures_are_computed_once(spark, stored):
    assert "Aggregate" not in plan_of(stored.dim_customers) and "/customers-" in plan_of(stored.dim_customers)
    assert "Aggregate" not in plan_of(stored.mart_customer_360)
    assert same(stored.mart_customer_360, marts.customer_360(stored.fct_orders, stored.dim_customers))
    assert same(marts.rfm_measures(stored.fct_orders, stored.order_stats), marts.rfm_measures(stored.fct_orders))


def test_rows_in_buckets_leave_no_table_and_no_setting(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key), sorted(t.name for t in spark.catalog.listTables())
    # more values than buckets, and rows that are not dealt out by them
    rows = stash(spark.range(100).selectExpr("id % 7 AS k", "id"), "in-buckets", (3, ["k"]))
    assert rows.count() == 100 and "Exchange" not in plan_of(rows.groupBy("k").count())
    assert sorted(map(tuple, rows.groupBy("k").count().collect())) == [(k, 15 if k < 2 else 14) for k in range(7)]
    assert before == (spark.conf.get(key), sorted(t.name for t in spark.catalog.listTables()))


def test_parts_join_the_narrow_lines(spark):
    plan = bindings.raw_invoices(registered_queries._tables(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (l_orderkey") < plan.index("Join Inner, (l_partkey")


def test_messages_are_checked_once(spark):
    proposals = spark.createDataFrame([(1, 1, "{}")], "customer_id long, attempt int, payload string")
    products = spark.createDataFrame([("A", "a")], "product_id string, description string")
    plan = offers.rejected(offers.check_offers(proposals, products))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("profanity") == 1


def test_products_without_id_or_description(spark):
    ids = spark.range(1).withColumnRenamed("id", "customer_id")
    profiles = ids.selectExpr(*[f"customer_id AS {c}" for c in offers.PROFILE_JSON_COLUMNS])
    explained = ids.selectExpr(
        "customer_id", "timestamp_ntz'2024-01-01 00:00:00' AS snapshot_date", "0.5D AS churn_probability",
        "array(named_struct('name', 'x', 'impact', 1D)) AS top_features",
    )
    listed = spark.createDataFrame(
        [(0, None, "n", 3), (0, "B", None, 2), (0, "A", "a%s", 1)],
        "customer_id long, product_id string, description string, position int",
    )
    block = offers.offer_context(profiles, explained, listed).first()["products_block"]
    assert block == "- A (description: a%s)\n- B (description: None)\n- null (description: n)"
