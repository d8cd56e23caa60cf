"""Tables for dashboards and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.functions.values import count_where, exact_mean, pretty_name, title_case
from patronlens.operators.scoring import by_risk, fixed_label


def percent_text(share: Column, places: int) -> Column:
    """``0.1234`` as ``12.3%``, rounded half up as a decimal."""
    percent = F.round(share.cast("decimal(9,6)") * 100, places).cast(f"decimal({places + 4},{places})")
    return F.concat(percent.cast("string"), F.lit("%"))


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("decimal(20,2)"), 2))


def dashboard_predictions(predictions: DataFrame, c360: DataFrame, rfm: DataFrame) -> DataFrame:
    """Predictions of customers that are in both marts."""
    return (
        predictions.select("customer_id", "snapshot_date", "churn_probability", "risk_band")
        .join(c360.select("customer_id", "country", "lifetime_revenue"), "customer_id")
        .join(rfm.select("customer_id", "segment", "frequency_lifetime"), "customer_id")
    )


def kpi_summary(predictions: DataFrame, interventions: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    return predictions.agg(
        F.count(F.lit(1)).alias("customers_scored"),
        count_where(F.col("risk_band") == "high").alias("high_risk"),
        F.round(exact_mean(F.col("churn_probability")), 6).alias("mean_probability"),
    ).withColumn("mean_probability_text", percent_text(F.col("mean_probability"), 2)).withColumn("interventions", interventions.agg(F.count(F.lit(1))).scalar())


def filter_options(dashboard: DataFrame) -> DataFrame:
    """The values a viewer can filter on: (field, value)."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("segment", "risk_band")]
    )
    return dashboard.select(F.inline(pairs)).distinct()


def risk_table(
    dashboard: DataFrame, segments: list[str] | None = None, bands: list[str] | None = None
) -> DataFrame:
    """The risk table, highest probability first; an empty filter keeps all rows."""
    rows = dashboard
    if segments:
        rows = rows.filter(F.col("segment").isin(*segments))
    if bands:
        rows = rows.filter(F.col("risk_band").isin(*bands))
    probability, money = F.col("churn_probability"), F.col("lifetime_revenue")
    return by_risk(
        rows.select(
            "customer_id",
            "country",
            "segment",
            "risk_band",
            "churn_probability",
            "lifetime_revenue",
            fixed_label(probability).alias("risk_label_fixed"),
            percent_text(probability, 1).alias("probability_text"),
            money_text(money).alias("revenue_text"),
            title_case(F.col("segment")).alias("segment_text"),
        )
    )


def score_lookup(ids: DataFrame, predictions: DataFrame) -> DataFrame:
    """The prediction of each requested customer, or status ``no_score``."""
    found = predictions.withColumn("found", F.lit(True))
    return (
        ids.select("customer_id")
        .join(found, "customer_id", "left")
        .withColumn("status", F.when(F.col("found"), "ok").otherwise("no_score"))
        .drop("found")
    )


def explain_report(
    ids: DataFrame, profiles: DataFrame, explanations: DataFrame, offers: DataFrame
) -> DataFrame:
    """Profile, explanation and offer of each requested customer with a status.

    The first missing part decides the status: ``no_profile``, ``no_panel_row``,
    ``no_valid_offer``; otherwise ``ok``. Like a failed request, a row that is not
    ``ok`` carries no parts.
    """
    def packed(df: DataFrame, name: str) -> DataFrame:
        columns = [c for c in df.columns if c != "customer_id"]
        return df.select("customer_id", F.struct(*columns).alias(name))

    status = (
        F.when(F.col("profile").isNull(), "no_profile")
        .when(F.col("explanation").isNull(), "no_panel_row")
        .when(F.col("retention_plan").isNull(), "no_valid_offer")
        .otherwise("ok")
    )
    parts = ("profile", "explanation", "retention_plan")
    return (
        ids.select("customer_id")
        .join(packed(profiles, "profile"), "customer_id", "left")
        .join(packed(explanations, "explanation"), "customer_id", "left")
        .join(packed(offers, "retention_plan"), "customer_id", "left")
        .withColumn("status", status)
        .select("customer_id", "status", *[F.when(F.col("status") == "ok", F.col(p)).alias(p) for p in parts])
    )


def profile_display(profiles: DataFrame) -> DataFrame:
    """Customer profiles as display texts."""
    interval = F.round(F.col("avg_purchase_interval").cast("decimal(20,6)"), 1).cast("decimal(20,1)")
    return profiles.select(
        "customer_id",
        title_case(F.col("segment")).alias("segment"),
        "lifetime_order_count",
        money_text(F.col("lifetime_revenue")).alias("lifetime_revenue"),
        "recency_days",
        "country",
        "rfm_score",
        F.concat(interval.cast("string"), F.lit(" days")).alias("avg_purchase_interval"),
        F.date_format("first_order_date", "yyyy-MM-dd").alias("first_order"),
    )


def explanation_table(explanations: DataFrame) -> DataFrame:
    """One row per top feature, ready for display."""
    impact = F.col("feature.impact")
    return explanations.select(
        "customer_id",
        "snapshot_date",
        fixed_label(F.col("churn_probability")).alias("risk_label_fixed"),
        F.posexplode("top_features").alias("n", "feature"),
    ).select(
        "customer_id",
        "snapshot_date",
        "risk_label_fixed",
        (F.col("n") + 1).alias("position"),
        pretty_name(F.col("feature.name")).alias("feature"),
        impact.alias("impact"),
        F.when(impact > 0, "increases risk").otherwise("decreases risk").alias("direction"),
        F.format_string("%+.2f", impact).alias("impact_text"),
    )
