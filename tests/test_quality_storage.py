from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from patronlens.functions.values import lower_names
from patronlens.operators import marts, quality, reporting
from patronlens.operators.quality import ACCEPTED, NOT_NULL, UNIQUE, Check
from patronlens.plans.warehouse import LAYERS, RawInputs, Warehouse, publish_all
from patronlens.schemas import INTERVENTIONS, PREDICTIONS
from patronlens.sources import bindings, storage, versions
from patronlens.sources.bindings import TestTables

FOLDER = "/root/testdata/sf0.001"


def test_each_check_passes_and_fails(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 9), (None, 9)], "k string, v int")
    checks = [
        Check("t", "k", NOT_NULL), Check("t", "k", UNIQUE), Check("t", "k", ACCEPTED, ("a",)),
        Check("t", "v", NOT_NULL, (), "warn"), Check("t", "v", UNIQUE), Check("t", "v", ACCEPTED, (1, 2, 9)),
    ]
    report = quality.quality_report({"t": df}, checks)
    got = {(r["column_name"], r["test"]): (r["failures"], r["passed"]) for r in report.collect()}
    assert got == {
        ("k", NOT_NULL): (2, False), ("k", UNIQUE): (1, False), ("k", ACCEPTED): (1, False),
        ("v", NOT_NULL): (1, False), ("v", UNIQUE): (1, False), ("v", ACCEPTED): (0, True),
    }
    with pytest.raises(ValueError, match=r"t.k not_null \(2\)"):
        quality.require_passed(report)


def test_warnings_do_not_fail(spark):
    df = spark.createDataFrame([(None,)], "k string")
    quality.require_passed(quality.quality_report({"t": df}, [Check("t", "k", NOT_NULL, (), "warn")]))


def test_standard_checks_cover_all_declared():
    kinds = [c.test for c in quality.STANDARD_CHECKS]
    assert (kinds.count(NOT_NULL), kinds.count(UNIQUE), kinds.count(ACCEPTED)) == (20, 8, 11)
    assert sum(c.severity == "warn" for c in quality.STANDARD_CHECKS) == 5


OFFER = "customer_id long, discount_pct int, channel string, product_focus string, messaging string"


def test_interventions_are_appended_once_per_batch(spark, tmp_path):
    path = str(tmp_path / "interventions")
    storage.create_interventions(spark, path)
    assert storage.read_interventions(spark, path).count() == 0
    offers = spark.createDataFrame([(1, 10, "email", "p", "hi")], OFFER)
    assert storage.append_interventions(offers, path, "run-1")
    assert not storage.append_interventions(offers, path, "run-1")  # a repeated run
    storage.create_interventions(spark, path)  # keeps the rows
    stamped = offers.withColumn("generated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert storage.append_interventions(stamped, path, "run-2")
    table = storage.read_interventions(spark, path)
    assert table.count() == 2 and table.filter("generated_at IS NULL").count() == 0
    assert table.schema == INTERVENTIONS
    storage.create_interventions(spark, path, reset=True)
    assert storage.read_interventions(spark, path).count() == 0
    assert storage.append_interventions(offers, path, "run-1") and storage.read_interventions(spark, path).count() == 1
    with pytest.raises(ValueError, match="batch id"):
        storage.append_interventions(offers, path, "../x")


def test_a_batch_that_failed_half_way_counts_once(spark, tmp_path):
    path = str(tmp_path / "interventions")
    storage.create_interventions(spark, path)
    offers = spark.createDataFrame([(i, 10, "email", "p", "hi") for i in range(4)], OFFER)
    # rows written by an attempt that died before it reached the ledger
    stamped = offers.withColumn("generated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    stamped.write.parquet(f"{path}/rows/batch=b/attempt=dead")
    assert storage.read_interventions(spark, path).count() == 0
    assert storage.append_interventions(offers, path, "b") and storage.read_interventions(spark, path).count() == 4
    # two writers that both committed: the first counts
    stamped.limit(1).write.parquet(f"{path}/rows/batch=b/attempt=late")
    versions._enter(spark, path, "b", "late")
    assert storage.read_interventions(spark, path).count() == 4


def test_predictions_are_replaced_as_a_whole(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), 0.5, "low", datetime(2024, 2, 1), "x")],
                                 "customer_id long, snapshot_date timestamp_ntz, churn_probability double, risk_band string, scored_at timestamp_ntz, other string")
    rows = rows.drop("other").withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    for _ in range(4):
        name = storage.write_predictions(rows, "test_predictions")
    assert spark.table(name).count() == 1 and spark.table(name).schema == PREDICTIONS
    assert len(versions.versions(spark, "analytics", "test_predictions")) == versions.KEPT_VERSIONS
    with pytest.raises(Exception, match="risk_band"):
        storage.write_predictions(rows.drop("risk_band"), "test_predictions")
    # a write that dies in a task, and one whose rows fail their check, leave the old rows
    broken = rows.withColumn("customer_id", F.when(F.col("customer_id") == 1, F.raise_error(F.lit("lost"))).cast("long"))
    with pytest.raises(Exception, match="lost"):
        storage.write_predictions(broken, "test_predictions")
    empty, verify = quality.watched(rows.withColumn("risk_band", F.lit("odd")), [Check("p", "risk_band", ACCEPTED, ("low",))])
    with pytest.raises(ValueError, match=r"p.risk_band accepted_values \(1\)"):
        storage.publish(empty, "analytics", "test_predictions", verify=verify)
    assert [r["risk_band"] for r in spark.table(name).collect()] == ["low"]
    # a table may be replaced from its own rows
    storage.write_predictions(spark.table(name).withColumn("churn_probability", F.lit(0.75)), "test_predictions")
    assert spark.table(name).first()["churn_probability"] == 0.75


def test_a_lookup_reads_a_few_pages(spark):
    stamp = F.lit("2024-06-01").cast("timestamp_ntz")
    rows = spark.range(60_000).select(
        F.col("id").alias("customer_id"), F.lit("2024-01-01").cast("date").alias("snapshot_date"),
        (F.col("id") / 60_000).alias("churn_probability"), F.lit("low").alias("risk_band"), stamp.alias("scored_at"),
    )
    name = storage.write_predictions(rows, "looked_up", buckets=4)

    def read_rows(df):
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    found = storage.lookup(spark, name, [4711])
    scanned = read_rows(found)
    assert [r["customer_id"] for r in found.collect()] == [4711]
    assert 0 < scanned <= 2 * storage.LOOKUP_PAGE_ROWS
    assert read_rows(storage.lookup(spark, name, [10**9])) == 0
    assert storage.lookup(spark, name, [1, 2, 10**9]).count() == 2


def test_checks_taken_while_writing(spark):
    df = spark.createDataFrame([("a", 1), (None, 7), (None, None)], "k string, v int")
    checks = [Check("t", "k", NOT_NULL, (), "warn"), Check("t", "v", ACCEPTED, (1, 2), "warn"), Check("t", "k", UNIQUE)]
    seen, verify = quality.watched(df, checks)
    assert storage.stash(seen, "t").count() == 3
    assert verify() == {checks[0]: 2, checks[1]: 1}


def test_landing_layout(spark, tmp_path):
    df = spark.range(3)
    path = storage.land_raw(df, f"file:{tmp_path}/", "raw_events")
    assert path.endswith("/raw/events") and spark.read.parquet(path).count() == 3


def test_shared_dir_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    fallback = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
    assert storage.shared_dir(spark) == (configured.rstrip("/") if configured else fallback)


def test_stash_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None, datetime(2024, 1, 1))], "a long, b string, c timestamp_ntz")
    again = storage.stash(df, "t")
    assert again.schema == df.schema and again.collect() == df.collect()


def test_publish_all_layers(spark):
    t = TestTables(spark, FOLDER)
    w = Warehouse(RawInputs(bindings.raw_invoices(t), bindings.raw_events(t), bindings.raw_support_tickets(t)), max_months=None)
    names = publish_all(w)
    assert set(names) == set(LAYERS)
    assert names["fct_orders"] == "core.fct_orders" and names["stg_events"] == "stg_stg_events"
    assert spark.table("core.churn_feature_panel").count() == spark.table("features_churn_features").count() == 10277
    # the published panel is partitioned by date, so a date filter prunes files
    plan = spark.table("core.churn_feature_panel").filter(F.col("snapshot_date") < F.lit("2020-01-01").cast("timestamp_ntz"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in text
    assert storage.read_published(spark, "marts", "mart_rfm_segments").count() == 147
    # tables by customer are bucketed alike: joins of them move no rows
    c360, rfm = spark.table("marts.mart_customer_360"), spark.table("marts.mart_rfm_segments")
    stamp = F.lit("2024-06-01").cast("timestamp_ntz")
    predictions = c360.select("customer_id", F.lit("2024-01-01").cast("date").alias("snapshot_date"), F.lit(0.5).alias("churn_probability"), F.lit("low").alias("risk_band"), stamp.alias("scored_at"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df, by = storage.clustered(predictions, buckets)
    predictions = spark.table(storage.publish(df, "analytics", "clustered_predictions", cluster_by=by))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for joined in (marts.customer_profile(c360, rfm), reporting.dashboard_predictions(predictions, c360, rfm)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_and_report_status(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 5)], "customer_id long")
    found = spark.createDataFrame([(1, 0.5)], "customer_id long, churn_probability double")
    assert {r["customer_id"]: r["status"] for r in reporting.score_lookup(ids, found).collect()} == {
        1: "ok", 2: "no_score", 3: "no_score", 4: "no_score"}

    def having(*customers):
        return spark.createDataFrame([(c, "x") for c in customers], "customer_id long, v string")

    report = reporting.explain_report(ids, having(1, 2, 3), having(1, 2), having(1, 4)).collect()
    assert {r["customer_id"]: r["status"] for r in report} == {1: "ok", 2: "no_valid_offer", 3: "no_panel_row", 4: "no_profile"}
    assert all((r["profile"] is not None) == (r["status"] == "ok") for r in report)


def test_display_names(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), 0.7, [("frequency_180d", 0.256), ("events_30d", -1.5)])],
                               "customer_id long, snapshot_date timestamp_ntz, churn_probability double, top_features array<struct<name:string,impact:double>>")
    rows = reporting.explanation_table(df).collect()
    assert [(r["feature"], r["direction"], r["impact_text"], r["risk_label_fixed"]) for r in rows] == [
        ("Frequency 180D", "increases risk", "+0.26", "High Risk"), ("Events 30D", "decreases risk", "-1.50", "High Risk")]


def test_lower_names(spark):
    assert lower_names(spark.createDataFrame([(1, 2)], "CustomerID int, B int")).columns == ["customerid", "b"]
