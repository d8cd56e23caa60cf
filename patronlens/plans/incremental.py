"""Bring a stored panel up to date after late rows by rebuilding the snapshots they touch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.operators import panel, staging
from patronlens.plans.warehouse import RawInputs, Warehouse

PARTITION = "snapshot_date"


def write_panel(rows: DataFrame, path: str) -> None:
    """Write panel rows by date; dates that ``rows`` doesn't hold stay as they are."""
    dated = rows.repartition(PARTITION, F.pmod(F.xxhash64("customer_id"), F.lit(FILES_OF_A_DATE)))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(path)


# a date is written by this many tasks at most, however many customers it has
FILES_OF_A_DATE = 8


def read_panel(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path).select(like.columns)


def _drop_dates_outside(spark: SparkSession, path: str, spans: DataFrame) -> None:
    """Delete the folders of dates that the grid no longer has."""
    bounds = spans.agg(F.min("first_snapshot"), F.max("last_snapshot")).first()
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = spark.read.parquet(path).select(F.col(PARTITION).cast("timestamp_ntz").alias(PARTITION)).distinct()
    for row in stored.collect():
        if bounds[0] is None or not bounds[0] <= row[PARTITION] <= bounds[1]:
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, f"{PARTITION}={row[PARTITION]:%Y-%m-%d}*")):
                fs.delete(status.getPath(), True)


def refresh_panel(path: str, before: Warehouse, now: Warehouse, late: RawInputs) -> list[datetime]:
    """Rebuild the dates of the panel at ``path`` that the late raw rows touch; returns them.

    ``before`` holds the inputs the panel was built from, ``now`` these and the late rows.
    An invoice that gained lines counts with its old and its new date.
    """
    spark = late.invoices.sparkSession
    invoices = staging.stage_invoices(late.invoices).select("invoice_no").distinct()
    changed = before.fct_orders.unionByName(now.fct_orders).join(invoices, "invoice_no", "left_semi")
    dates = panel.touched_dates(
        before.customer_spans,
        now.customer_spans,
        changed,
        staging.stage_events(late.events),
        staging.stage_tickets(late.tickets),
    )
    if dates:
        rows = panel.feature_panel(now.customer_spans, now.fct_orders, now.stg_events, now.stg_support_tickets, dates)
        write_panel(rows, path)
    _drop_dates_outside(spark, path, now.customer_spans)
    return dates
