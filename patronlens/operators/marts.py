"""Customer marts: customer 360 and RFM segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.functions.dates import day_diff
from patronlens.functions.values import exact_sum, ratio
from patronlens.operators.core import completed
from patronlens.operators.order_statistics import with_ntiles
from patronlens.sources.storage import stash


def completed_order_stats(orders: DataFrame) -> DataFrame:
    """Lifetime figures over completed orders, shared by both marts.

    ``orders`` holds each invoice number once per customer, so counting the rows with
    a number is the distinct count.
    """
    return completed(orders).groupBy("customer_id").agg(
        F.count("invoice_no").alias("order_count"),
        exact_sum(F.col("total_revenue")).alias("revenue"),
        F.min("invoice_date").alias("first_order_date"),
        F.max("invoice_date").alias("last_order_date"),
    )


def customer_360(orders: DataFrame, customers: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Every customer with its completed-order figures (``stats``, if stored already), NULL where it has none."""
    if stats is None:
        stats = completed_order_stats(orders)
    return customers.select("customer_id", "country").join(stats, "customer_id", "left").select(
        "customer_id",
        "country",
        "first_order_date",
        "last_order_date",
        F.col("order_count").alias("lifetime_order_count"),
        F.col("revenue").alias("lifetime_revenue"),
    )


def rfm_measures(orders: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Recency, frequency, money and purchase interval of customers with a completed order.

    ``stats`` are the figures of ``orders``, if they are stored already.
    """
    if stats is None:
        stats, newest = completed_order_stats(orders), completed(orders).agg(F.max("invoice_date"))
    else:
        newest = stats.agg(F.max("last_order_date"))
    as_of = newest.scalar()
    lifespan = day_diff(F.col("first_order_date"), F.col("last_order_date"))
    return stats.select(
        "customer_id",
        day_diff(F.col("last_order_date"), as_of).alias("recency_days"),
        F.col("order_count").alias("frequency_lifetime"),
        F.col("revenue").alias("monetary_lifetime"),
        F.when(F.col("order_count") > 1, ratio(lifespan, F.col("order_count") - 1)).alias(
            "avg_purchase_interval"
        ),
    )


def rfm_segments(orders: DataFrame, tiles: int = 5, stats: DataFrame | None = None) -> DataFrame:
    """RFM scores and the segment. Runs small jobs to find the tile boundaries."""
    measures = stash(rfm_measures(orders, stats), "rfm")
    scored = with_ntiles(
        measures,
        {
            "r_score": ("recency_days", True),
            "f_score": ("frequency_lifetime", False),
            "m_score": ("monetary_lifetime", False),
        },
        tie="customer_id",
        tiles=tiles,
    )
    return with_segment(scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score")))


def with_segment(scored: DataFrame) -> DataFrame:
    """The first matching rule names the segment."""
    r, f = F.col("r_score"), F.col("f_score")
    return scored.withColumn(
        "segment",
        F.when((r >= 4) & (f >= 4), "champions")
        .when(f >= 4, "loyal")
        .when((r <= 2) & (f >= 3), "at_risk")
        .when(r <= 2, "hibernating")
        .when((r >= 4) & (f <= 2), "new")
        .otherwise("standard"),
    )


def customer_profile(c360: DataFrame, rfm: DataFrame) -> DataFrame:
    """Customers that have both a 360 row and an RFM row."""
    return c360.join(rfm, "customer_id").select(
        "customer_id",
        "country",
        "first_order_date",
        "last_order_date",
        "lifetime_order_count",
        "lifetime_revenue",
        "recency_days",
        "frequency_lifetime",
        "monetary_lifetime",
        "avg_purchase_interval",
        "segment",
        "rfm_score",
    )
