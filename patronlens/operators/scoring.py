"""From panel rows to scored customers: latest snapshot, risk bands, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.fixed_values import FIXED_LABEL_CUTS, FIXED_LABEL_REST, ID_COLUMNS, RISK_BANDS
from patronlens.operators.order_statistics import quantiles


def latest_snapshot(panel: DataFrame) -> DataFrame:
    """The newest row of each customer; ``panel`` has one row per customer and date.

    One hash aggregate takes every column at the customer's newest date, so ``panel`` is
    read once and, where it is partitioned by customer already, not shuffled.
    """
    keys = ("customer_id", "snapshot_date")
    rest = [c for c in panel.columns if c not in keys]
    dated = panel.filter(F.col("customer_id").isNotNull() & F.col("snapshot_date").isNotNull())
    newest = dated.groupBy("customer_id").agg(
        F.max("snapshot_date").alias("snapshot_date"), *[F.max_by(c, "snapshot_date").alias(c) for c in rest]
    )
    return newest.select(panel.columns)


def band_edges(scored: DataFrame) -> list[float]:
    """The two inner tercile edges of the probabilities."""
    return quantiles(scored, "churn_probability", [1 / 3, 2 / 3])


def risk_band(probability: Column, edges: list[float]) -> Column:
    """Right-closed bands; equal edges leave the middle band empty instead of failing."""
    low, medium, high = RISK_BANDS
    return (
        F.when(probability <= edges[0], low)
        .when(probability <= edges[1], medium)
        .when(probability.isNotNull(), high)
    )


def with_risk_bands(scored: DataFrame, scored_at: Column | None = None) -> DataFrame:
    """Add ``risk_band`` by terciles of the scores themselves, and ``scored_at``.

    Scans ``scored`` a few times to find the edges, so pass a stored table.
    """
    edges = band_edges(scored)
    when = F.current_timestamp().cast("timestamp_ntz") if scored_at is None else scored_at
    return scored.select(
        "customer_id",
        F.col("snapshot_date").cast("date").alias("snapshot_date"),
        "churn_probability",
        risk_band(F.col("churn_probability"), edges).alias("risk_band"),
        when.alias("scored_at"),
    )


def fixed_label(probability: Column) -> Column:
    """The display label with fixed cut-offs; it may disagree with the tercile band."""
    label = F.lit(FIXED_LABEL_REST)
    for cut, text in reversed(FIXED_LABEL_CUTS):
        label = F.when(probability >= cut, text).otherwise(label)
    return label


def high_risk(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("risk_band") == "high").select(
        "customer_id", "snapshot_date", "churn_probability"
    )


def by_risk(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Highest probability first; ``limit`` of None or 0 keeps all rows."""
    ordered = df.orderBy(F.col("churn_probability").desc_nulls_first(), *[c for c in ID_COLUMNS if c in df.columns])
    return ordered.limit(limit) if limit else ordered
