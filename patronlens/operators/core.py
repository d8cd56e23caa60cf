"""Facts and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.functions.dates import timestamp_text
from patronlens.functions.values import surrogate_key


def order_lines(stg_invoices: DataFrame) -> DataFrame:
    """Invoice lines with a text key and their revenue; no shuffle.

    The key covers four columns, so lines that differ in price or quantity only
    share it; the data-quality report counts those.
    """
    key = surrogate_key(
        F.col("invoice_no"), F.col("stock_code"), timestamp_text(F.col("invoice_date")), F.col("customer_id")
    )
    return stg_invoices.select(
        key.alias("order_line_id"),
        "invoice_no",
        "stock_code",
        "description",
        "quantity",
        "invoice_date",
        "unit_price",
        "customer_id",
        "country",
        "is_cancelled",
        (F.col("quantity") * F.col("unit_price")).alias("line_revenue"),
    )


def invoice_totals(lines: DataFrame) -> DataFrame:
    """One row per (invoice, customer): the only pass over the lines that orders and customers need.

    The largest of several texts needs a sort-based aggregate, so the lines are first
    grouped by country too, with numbers only, and the few rows left give the largest.
    """
    by_country = lines.groupBy("invoice_no", "customer_id", "country").agg(
        F.min("invoice_date").alias("first"),
        F.max("invoice_date").alias("last"),
        F.bool_or("is_cancelled").alias("cancelled"),
        F.sum("quantity").alias("items"),
        F.sum(F.col("line_revenue").cast("decimal(20,6)")).alias("revenue"),
        F.count(F.lit(1)).alias("lines"),
    )
    return by_country.groupBy("invoice_no", "customer_id").agg(
        F.min("first").alias("invoice_date"),
        F.max("last").alias("last_line_date"),
        F.max("country").alias("country"),
        F.bool_or("cancelled").alias("is_cancelled"),
        F.sum("items").alias("total_quantity"),
        F.sum("revenue").cast("double").alias("total_revenue"),
        F.sum("lines").alias("line_count"),
    )


def orders(totals: DataFrame) -> DataFrame:
    return totals.drop("last_line_date")


def customers(totals: DataFrame) -> DataFrame:
    """One row per customer over all its invoices, cancelled ones included.

    ``totals`` holds each invoice number once per customer, so counting the rows with
    a number is the distinct count.
    """
    by_country = totals.groupBy("customer_id", "country").agg(
        F.min("invoice_date").alias("first"),
        F.max("last_line_date").alias("last"),
        F.count("invoice_no").alias("invoices"),
    )
    return by_country.groupBy("customer_id").agg(
        F.max("country").alias("country"),
        F.min("first").alias("first_order_date"),
        F.max("last").alias("last_order_date"),
        F.sum("invoices").alias("lifetime_order_count"),
    )


def products(lines: DataFrame) -> DataFrame:
    """One row per stock code with its most frequent description.

    Ties go to the first description in text order. Counting and finding the largest
    count are hash aggregates; only the descriptions that reach it are compared as texts.
    """
    counted = (
        lines.filter(F.col("stock_code").isNotNull())
        .groupBy("stock_code", "description")
        .agg(F.count(F.lit(1)).alias("line_count"))
    )
    most = counted.groupBy("stock_code").agg(F.max("line_count").alias("line_count"))
    return (
        counted.join(most, ["stock_code", "line_count"], "left_semi")
        .groupBy(F.col("stock_code").alias("product_id"))
        .agg(F.min("description").alias("description"))
    )


def completed(orders_df: DataFrame) -> DataFrame:
    return orders_df.filter(~F.col("is_cancelled")).select(
        "customer_id", "invoice_no", "invoice_date", "total_revenue"
    )
