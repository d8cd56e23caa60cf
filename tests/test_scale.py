"""Steps whose memory or time would otherwise grow with the tables."""

from __future__ import annotations

import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

import registered_queries
from patronlens.operators import offers, panel, scoring
from patronlens.plans.retention import retry_rounds


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spans_of(spark, customers):
    first, last = datetime(2020, 1, 1), datetime(2020, 12, 1)
    return spark.range(customers).select(
        F.col("id").alias("customer_id"),
        F.lit(first).cast("timestamp_ntz").alias("first_snapshot"),
        F.lit(last).cast("timestamp_ntz").alias("last_snapshot"),
    )


def test_tasks_of_the_panel_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(panel, "GROUPS_PER_TASK", 100)
    orders = spark.createDataFrame(
        [(1, datetime(2020, 3, 5), False, 2.0)],
        "customer_id long, invoice_date timestamp_ntz, is_cancelled boolean, total_revenue double",
    )
    few, many = (panel.order_features(spans_of(spark, n), orders) for n in (10, 100))
    assert "REPARTITION_BY_COL" in plan_of(few)
    # 100 customers of 12 months in groups of at most 100, whatever the session's shuffle partitions
    assert re.search(r"hashpartitioning\(customer_id\S*, 12\), REPARTITION_BY_NUM", plan_of(many))
    assert many.count() == 1200
    assert few.filter("monetary_180d = 2").count() == many.filter("monetary_180d = 2").count() == 5


def test_latest_snapshot_reads_the_panel_once(spark):
    def day(n):
        return datetime(2024, n, 1)

    rows = [(1, day(1), 5.0), (1, day(3), None), (1, day(2), 7.0), (2, day(1), 1.0), (None, day(4), 9.0), (3, None, 2.0)]
    table = spark.createDataFrame(rows, "customer_id long, snapshot_date timestamp_ntz, x double")
    found = scoring.latest_snapshot(table)
    plan = plan_of(found)
    assert sorted(map(tuple, found.collect())) == [(1, day(3), None), (2, day(1), 1.0)]
    assert "Join" not in plan and "SortAggregate" not in plan and plan.count("Scan") == 1


def test_long_texts_are_not_sent_to_every_task(spark):
    ids = spark.range(10).select(F.col("id").alias("customer_id"))
    profiles = ids.select(*[F.col("customer_id").alias(c) for c in offers.PROFILE_JSON_COLUMNS])
    plan = plan_of(ids.join(offers.profile_json(profiles), "customer_id", "left"))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_contexts_are_built_once_however_many_rounds(spark):
    built = spark.sparkContext.accumulator(0)

    def texts(batches):
        for batch in batches:
            built.add(len(batch))
            yield batch

    contexts = spark.range(5).selectExpr("id AS customer_id", "'p' AS profile_json", "cast(null AS string) AS feedback")
    contexts = contexts.mapInPandas(texts, contexts.schema)
    products = spark.createDataFrame([("A",)], "product_id string")
    rounds = retry_rounds(
        contexts, lambda requests, attempt: requests.select("customer_id", F.lit("no json").alias("payload")), products, 3
    )
    asked = rounds.requests.collect()
    assert built.value == 5
    assert sorted((r["customer_id"], r["attempt"], r["feedback"]) for r in asked) == sorted(
        (c, n, None if n == 1 else "malformed_json") for c in range(5) for n in (1, 2, 3)
    )
    assert rounds.requests.columns == ["customer_id", "profile_json", "feedback", "attempt"]


def test_products_are_counted_once_where_lines_are_stored(spark):
    warehouse = registered_queries._warehouse(spark, "/root/testdata/sf0.001", store_lines=True)
    plan = plan_of(warehouse.dim_products)
    assert "Aggregate" not in plan and "/products-" in plan


def test_tables_are_judged_by_more_than_their_files(spark):
    folder = "/root/testdata/sf0.001"
    part = registered_queries._tables(spark, folder).part
    reckoned = int(str(part._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert reckoned >= 8 * Path(folder, "part.parquet").stat().st_size
