"""Typed, de-duplicated staging views over the raw inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.functions.dates import day_diff, parse_timestamp
from patronlens.functions.values import whole_number


INVOICE_KEY = ["invoice_no", "customer_id"]


def stage_invoices(raw_invoices: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct typed invoice lines with a customer.

    The sheet is part of the line, so copies are removed within a sheet only. The
    customer filter runs before the shuffle. That is by invoice and customer, so removing
    copies and the totals of each invoice need no other one. ``tasks`` is the number of
    parts it makes (None: Spark chooses).
    """
    number = F.col("InvoiceNo")
    parts = [] if tasks is None else [tasks]
    return (
        raw_invoices.filter(F.col("CustomerID").isNotNull())
        .select(
            number.alias("invoice_no"),
            F.col("StockCode").alias("stock_code"),
            F.col("Description").alias("description"),
            whole_number(raw_invoices, "Quantity").alias("quantity"),
            parse_timestamp(F.col("InvoiceDate")).alias("invoice_date"),
            F.col("UnitPrice").cast("double").alias("unit_price"),
            whole_number(raw_invoices, "CustomerID").alias("customer_id"),
            F.col("Country").alias("country"),
            F.col("source_sheet"),
            F.coalesce(F.substring(number, 1, 1) == "C", F.lit(False)).alias("is_cancelled"),
        )
        .repartition(*parts, *INVOICE_KEY)
        .distinct()
    )


def stage_events(raw_events: DataFrame) -> DataFrame:
    return raw_events.select(
        "event_id", "customer_id", "snapshot_date", "event_timestamp", "event_type"
    ).filter(F.col("customer_id").isNotNull())


def stage_tickets(raw_tickets: DataFrame) -> DataFrame:
    """Tickets with their age in days; an open ticket ages up to the snapshot."""
    closed_at = F.coalesce("resolved_at", "snapshot_date")
    return raw_tickets.filter(F.col("customer_id").isNotNull()).select(
        "ticket_id",
        "customer_id",
        "snapshot_date",
        "created_at",
        "resolved_at",
        "status",
        "topic",
        day_diff(F.col("created_at"), closed_at).alias("resolution_days"),
    )
