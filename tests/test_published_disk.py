"""Publishing takes little disk beside the tables: no shuffle, copy or padding outlives its use."""

from __future__ import annotations

import time
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import registered_queries
from patronlens.operators import core
from patronlens.plans.warehouse import LAYERS, RawInputs, Warehouse, publish_all
from patronlens.sources import bindings, storage
from patronlens.sources.bindings import TestTables

FOLDER = "/root/testdata/sf0.001"


def local(uri):
    return Path(unquote(urlparse(uri).path))


def files(df):
    return [local(f) for f in df.inputFiles()]


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {name for name in names if name.startswith("shuffle_")}


def stashes(spark):
    app = local(f"{storage.shared_dir(spark)}/patronlens/{spark.sparkContext.applicationId}")
    return {p.name for p in app.iterdir()} if app.exists() else set()


@pytest.fixture(scope="module")
def published(spark):
    before = {k: spark.conf.get(k, None) for k in [*storage.SPARE_DISK, storage.CONCURRENT_WRITERS]}, shuffle_files(spark), stashes(spark)
    counts = registered_queries.queries()["published_layers"](spark, FOLDER)
    return *before, counts


def test_settings_are_those_of_before(spark, published):
    assert {k: spark.conf.get(k, None) for k in published[0]} == published[0]


def test_shuffles_are_gone_when_the_tables_are_written(spark, published):
    for _ in range(50):  # they are deleted in the background
        if not (left := shuffle_files(spark) - published[1]):
            break
        time.sleep(0.2)
    assert not left


def test_raw_lines_totals_and_copies_of_tables_are_deleted(spark, published):
    kept = sorted(name[:-33] for name in stashes(spark) - published[2])
    assert kept == ["customer-spans", "order-stats", "rfm", "stg-invoices"]


def test_counting_the_lines_joins_and_shuffles_nothing_again(spark, published):
    plan = spark.table("stg_stg_invoices")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # as before, they are the lines of the raw inputs
    t = TestTables(spark, FOLDER)
    plain = Warehouse(RawInputs(bindings.raw_invoices(t), bindings.raw_events(t), bindings.raw_support_tickets(t)), None)
    for table in ("stg_invoices", "fct_order_lines", "fct_orders", "dim_customers", "dim_products", "churn_feature_panel", "mart_customer_360"):
        b = getattr(plain, table)
        a = storage.read_published(spark, LAYERS[table], table).select(b.columns)  # the panel's date is stored last
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert {r["table_name"] for r in published[3].collect()} == set(LAYERS)


def test_totals_of_published_lines_need_no_shuffle(spark, published):
    assert "Exchange" not in core.invoice_totals(spark.table("core.fct_order_lines"))._jdf.queryExecution().executedPlan().toString()


def test_files_are_compact(spark, published):
    for table, layer in LAYERS.items():
        if layer in storage.TABLE_LAYERS:
            for f in files(spark.table(f"{layer}.{table}")):
                meta = pq.read_metadata(f)
                assert meta.num_rows == 0 or meta.row_group(0).column(0).compression == "ZSTD"
    # a Bloom filter of 20 customers has no 1 MB
    assert max(f.stat().st_size for f in files(spark.table("core.dim_customers"))) < 64 << 10


def test_few_tasks_write_the_panel(spark, monkeypatch):
    """The groups are cut into many tasks, the files of a date are not."""
    monkeypatch.setattr("patronlens.operators.panel.GROUPS_PER_TASK", 100)  # 103 tasks
    t = TestTables(spark, FOLDER)
    publish_all(Warehouse(RawInputs(bindings.raw_invoices(t), bindings.raw_events(t), bindings.raw_support_tickets(t)), None))
    panel = spark.table("core.churn_feature_panel")
    assert panel.count() == 10277
    most = panel.select("snapshot_date", F.input_file_name().alias("f")).groupBy("snapshot_date").agg(F.countDistinct("f")).toDF("d", "n").agg(F.max("n")).first()[0]
    assert most <= 3 * spark.sparkContext.defaultParallelism
