"""Customer x month feature panel with the churn label.

The panel needs, for each customer and month start, orders from 180 days before to 90
days after it, and the events and tickets of that snapshot. A join of snapshots and
orders on customer and date range grows with the square of a customer's history.
Here every source is first reduced to few narrow rows per customer, all sources are
shuffled once by customer, and only then is each row expanded to the month starts it
counts for. The final grouping reuses that partitioning.

A hot customer stays small: orders are reduced to at most two rows per customer and
day, events and tickets to one row per customer and snapshot, before the shuffle.

The rows are many times more after the expansion than Spark sees in the shuffle, so the
number of tasks follows from the customer months that the spans hold.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.fixed_values import (
    ENGAGEMENT_DAYS,
    FEATURE_COLUMNS,
    FORBIDDEN_COLUMNS,
    HORIZON_DAYS,
    ID_COLUMNS,
    LABEL_COLUMN,
    LOOKBACK_DAYS,
    MAX_MONTHS,
    RECENT_DAYS,
)
from patronlens.functions.dates import (
    day_diff,
    days,
    half_day,
    month_ceil,
    month_floor,
    month_starts,
    months,
)
from patronlens.functions.values import count_where, ratio
from patronlens.operators.core import completed

GROUPS_PER_TASK = 250_000  # customer months that one task groups at most, about


def _snap() -> Column:
    return F.col("snapshot_date")


def _ntz(date: datetime) -> Column:
    return F.lit(date.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


# --- snapshot grid ---------------------------------------------------------------------------

def snapshot_bounds(orders: DataFrame, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """One row: the range of snapshot dates with full history and a full label window."""
    return completed(orders).agg(
        (F.min("invoice_date") + days(horizon_days)).alias("range_start"),
        (F.max("invoice_date") - days(horizon_days)).alias("range_end"),
    )


def customer_spans(
    orders: DataFrame,
    customers: DataFrame,
    max_months: int | None = MAX_MONTHS,
    horizon_days: int = HORIZON_DAYS,
) -> DataFrame:
    """First and last snapshot of each customer that has any.

    The grid is every month start in the bounds, at most ``max_months`` counted from
    the month of the lower bound (None: all). A customer enters the grid with their first order.
    """
    bounds = snapshot_bounds(orders, horizon_days)
    last = month_floor(F.col("range_end"))
    if max_months is not None:
        last = F.least(last, month_floor(F.col("range_start")) + months(max_months - 1))
    limits = bounds.select(
        F.struct(month_ceil(F.col("range_start")).alias("first"), last.alias("last")).alias("limits")
    ).scalar()
    return (
        customers.filter(F.col("first_order_date").isNotNull())
        .withColumn("limits", limits)
        .select(
            "customer_id",
            F.greatest(month_ceil(F.col("first_order_date")), F.col("limits.first")).alias("first_snapshot"),
            F.col("limits.last").alias("last_snapshot"),
        )
        .filter(F.col("first_snapshot") <= F.col("last_snapshot"))
    )


def snapshot_dates(spans: DataFrame) -> DataFrame:
    """One row per customer and snapshot, without a join against the grid."""
    return spans.select(
        "customer_id",
        F.explode(month_starts(F.col("first_snapshot"), F.col("last_snapshot"))).alias("snapshot_date"),
    )


def newest(spans: DataFrame) -> tuple[DataFrame, list[datetime] | None]:
    """The spans cut to the last snapshot of each customer, and all these dates (at most one per month of the grid).

    The panel over both has the newest row of each customer, as the whole panel has it. ``spans``
    are read twice, so pass a stored table.
    """
    dates = [r[0] for r in spans.select("last_snapshot").distinct().collect()]
    return spans.withColumn("first_snapshot", F.col("last_snapshot")), dates or None


# --- sources reduced to narrow rows ----------------------------------------------------------

def _order_days(orders: DataFrame, dates: list[datetime] | None = None) -> DataFrame:
    """Orders by customer and half day, with the month starts they can count for.

    With ``dates`` those that can count for none of them are left out by their plain time,
    before anything is derived from it.
    """
    done = ~F.col("is_cancelled")
    if dates is not None:
        low, high = min(dates) - timedelta(LOOKBACK_DAYS + 1), max(dates) + timedelta(HORIZON_DAYS + 1)
        orders = orders.filter(F.col("invoice_date").between(_ntz(low), _ntz(high)))
    return (
        orders.filter(F.col("invoice_date").isNotNull())
        .select(
            "customer_id",
            half_day(F.col("invoice_date")).alias("day"),
            "is_cancelled",
            # decimal, so that a recomputed task repeats its total exactly
            F.when(done, F.col("total_revenue").cast("decimal(20,6)")).alias("revenue"),
        )
        .groupBy("customer_id", "day")
        .agg(
            count_where(done).alias("done"),
            count_where(F.col("is_cancelled")).alias("cancelled"),
            F.sum("revenue").cast("decimal(20,6)").alias("revenue"),
        )
        .withColumn("first_month", month_ceil(F.col("day") - days(HORIZON_DAYS)))
        .withColumn("last_month", month_floor(F.col("day") + days(LOOKBACK_DAYS)))
    )


def _recent(ts: Column) -> Column:
    return (ts <= _snap()) & (ts > _snap() - days(RECENT_DAYS))


def _event_counts(events: DataFrame) -> DataFrame:
    ts = F.col("event_timestamp")
    return (
        events.filter(_recent(ts))
        .groupBy("customer_id", "snapshot_date")
        .agg(
            count_where(ts > _snap() - days(ENGAGEMENT_DAYS)).alias("events_30d"),
            F.count(F.lit(1)).alias("events_90d"),
        )
    )


def _ticket_totals(tickets: DataFrame) -> DataFrame:
    return (
        tickets.filter(_recent(F.col("created_at")))
        .groupBy("customer_id", "snapshot_date")
        .agg(
            F.count(F.lit(1)).alias("tickets"),
            F.sum("resolution_days").alias("resolution_total"),
            F.count("resolution_days").alias("resolution_count"),
            F.max("created_at").alias("last_ticket"),
        )
    )


def _at_snapshot(df: DataFrame) -> DataFrame:
    return df.withColumn("first_month", _snap()).withColumn("last_month", _snap()).drop("snapshot_date")


# --- the rollup ------------------------------------------------------------------------------

def _customer_months(spans: DataFrame, dates: list[datetime] | None) -> int:
    """Rows of the panel, or with ``dates`` no fewer than it has of them."""
    held = F.size(month_starts(F.col("first_snapshot"), F.col("last_snapshot"))).cast("long")
    if dates is not None:
        held = F.least(held, F.lit(len(dates)).cast("long"))
    return spans.agg(F.sum(held)).first()[0] or 0


def _by_customer(rows: DataFrame, groups: int) -> DataFrame:
    """The rows dealt out by customer, over so many tasks that each has GROUPS_PER_TASK groups at most."""
    tasks = ceil(groups / GROUPS_PER_TASK)
    if tasks <= rows.sparkSession.sparkContext.defaultParallelism:
        return rows.repartition("customer_id")  # small: Spark chooses
    return rows.repartition(tasks, "customer_id")


def _rollup(
    spans: DataFrame, parts: list[DataFrame], measures: list[Column], dates: list[datetime] | None = None
) -> DataFrame:
    """Shuffle all parts once by customer, expand to month starts, group, keep the spine.

    With ``dates`` only rows that count for these snapshots are shuffled and expanded. The
    spans are read twice, so pass a stored table.
    """
    spine = spans.select(
        "customer_id",
        F.col("first_snapshot").alias("first_month"),
        F.col("last_snapshot").alias("last_month"),
        F.lit(1).alias("in_spine"),
    )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spine, *parts])
    if dates is not None:
        low, high = _ntz(min(dates)), _ntz(max(dates))
        rows = rows.filter((F.col("first_month") <= high) & (F.col("last_month") >= low))
        rows = rows.withColumns(
            {"first_month": F.greatest("first_month", low), "last_month": F.least("last_month", high)}
        )
    expanded = _by_customer(rows, _customer_months(spans, dates)).withColumn(
        "snapshot_date", F.explode(month_starts(F.col("first_month"), F.col("last_month")))
    )
    if dates is not None:
        expanded = expanded.filter(_snap().isin([_ntz(d) for d in dates]))
    return (
        expanded.groupBy("customer_id", "snapshot_date")
        .agg(F.max("in_spine").alias("in_spine"), *measures)
        .filter(F.col("in_spine") == 1)
        .drop("in_spine")
    )


def _order_measures() -> list[Column]:
    day, done = F.col("day"), F.col("done")
    cancelled = F.col("cancelled")
    past = day <= _snap()
    in_lookback = past & (day > _snap() - days(LOOKBACK_DAYS))
    recent = _recent(day)
    prior = (day <= _snap() - days(RECENT_DAYS)) & (day > _snap() - days(LOOKBACK_DAYS))
    future = (day > _snap()) & (day <= _snap() + days(HORIZON_DAYS))

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    return [
        F.max(F.when(past & (done > 0), day)).alias("last_order"),
        total(in_lookback, done).alias("frequency_180d"),
        F.sum(F.when(in_lookback, F.col("revenue"))).cast("double").alias("monetary_180d"),
        total(recent, done).alias("orders_recent_90d"),
        total(prior, done).alias("orders_prior_90d"),
        total(recent, done + cancelled).alias("total_invoices_90d"),
        total(recent, cancelled).alias("cancelled_invoices_90d"),
        F.coalesce(F.max(F.when(future & (done > 0), F.lit(1))), F.lit(0)).alias("has_future_order"),
    ]


def _event_measures() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events_30d", "events_90d")]


def _ticket_measures() -> list[Column]:
    return [
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("support_tickets_90d"),
        ratio(F.sum("resolution_total"), F.sum("resolution_count")).alias("avg_resolution_days_90d"),
        F.max("last_ticket").alias("last_ticket"),
    ]


def order_features(spans: DataFrame, orders: DataFrame, dates: list[datetime] | None = None) -> DataFrame:
    return _rollup(spans, [_order_days(orders, dates)], _order_measures(), dates).select(
        "customer_id",
        "snapshot_date",
        day_diff(F.col("last_order"), _snap()).alias("days_since_last_order"),
        "frequency_180d",
        "monetary_180d",
        "orders_recent_90d",
        "orders_prior_90d",
        "total_invoices_90d",
        "cancelled_invoices_90d",
        "has_future_order",
    )


def event_features(spans: DataFrame, events: DataFrame) -> DataFrame:
    return _rollup(spans, [_at_snapshot(_event_counts(events))], _event_measures())


def ticket_features(spans: DataFrame, tickets: DataFrame) -> DataFrame:
    part = _at_snapshot(_ticket_totals(tickets))
    return _rollup(spans, [part], _ticket_measures()).select(
        "customer_id",
        "snapshot_date",
        "support_tickets_90d",
        "avg_resolution_days_90d",
        day_diff(F.col("last_ticket"), _snap()).alias("days_since_last_ticket"),
    )


def feature_panel(
    spans: DataFrame,
    orders: DataFrame,
    events: DataFrame,
    tickets: DataFrame,
    dates: list[datetime] | None = None,
) -> DataFrame:
    """The full panel: ten features, the BI-only recency and the label, per customer and month.

    ``dates`` limits it to these snapshots; their rows are those of the full panel.
    """
    parts = [
        _order_days(orders, dates),
        _at_snapshot(_event_counts(events)),
        _at_snapshot(_ticket_totals(tickets)),
    ]
    measures = _order_measures() + _event_measures() + _ticket_measures()
    return _rollup(spans, parts, measures, dates).select(
        "customer_id",
        "snapshot_date",
        day_diff(F.col("last_order"), _snap()).alias("days_since_last_order"),
        "frequency_180d",
        "monetary_180d",
        ratio(F.col("orders_recent_90d"), F.col("orders_prior_90d")).alias("order_trend_90d"),
        ratio(F.col("cancelled_invoices_90d"), F.col("total_invoices_90d")).alias("return_cancel_rate_90d"),
        "events_30d",
        "events_90d",
        ratio(F.col("events_30d"), F.col("events_90d") / F.lit(3.0)).alias("engagement_decay_30d"),
        "support_tickets_90d",
        "avg_resolution_days_90d",
        day_diff(F.col("last_ticket"), _snap()).alias("days_since_last_ticket"),
        (F.lit(1) - F.col("has_future_order")).alias(LABEL_COLUMN),
    )


def touched_dates(
    spans_before: DataFrame, spans: DataFrame, orders: DataFrame, events: DataFrame, tickets: DataFrame
) -> list[datetime]:
    """The snapshots whose panel rows may differ, at most one per month of the grid.

    ``orders``, ``events`` and ``tickets`` are the rows that came, went or changed (old and
    new form); the spans those of all customers, before and now. Month starts that only one
    of a customer's two spans holds are touched too.
    """
    grid = spans.agg(F.min("first_snapshot").alias("first"), F.max("last_snapshot").alias("last"))
    months = [_order_days(orders).select("first_month", "last_month")]
    months += [df.select(_snap().alias("first_month"), _snap().alias("last_month")) for df in (events, tickets)]
    old = spans_before.select("customer_id", F.col("first_snapshot").alias("old_first"), F.col("last_snapshot").alias("old_last"))
    both = spans.join(old, "customer_id", "full")
    moved_start = ~F.col("first_snapshot").eqNullSafe(F.col("old_first"))
    moved_end = ~F.col("last_snapshot").eqNullSafe(F.col("old_last"))
    ends = F.least("last_snapshot", "old_last"), F.greatest("last_snapshot", "old_last")
    months.append(both.filter(moved_start).select(F.least("first_snapshot", "old_first"), F.greatest("first_snapshot", "old_first")))
    months.append(both.filter(moved_end).select(*ends))
    # a customer in one of the two only: all of the span
    months.append(both.filter(F.col("first_snapshot").isNull() | F.col("old_first").isNull()).select(
        F.coalesce("first_snapshot", "old_first"), F.coalesce("last_snapshot", "old_last")
    ))
    ranges = reduce(DataFrame.union, months).distinct()
    touched = ranges.toDF("low", "high").select(F.explode(month_starts(F.col("low"), F.col("high"))).alias("date")).distinct()
    bounds = grid.select(F.struct("first", "last")).scalar()
    inside = touched.filter(F.col("date").between(bounds["first"], bounds["last"]))
    return sorted(r["date"] for r in inside.collect())


# --- model view of the panel -----------------------------------------------------------------

def churn_features(panel: DataFrame) -> DataFrame:
    """The columns a model may see, plus ids and label."""
    return panel.select(*ID_COLUMNS, *FEATURE_COLUMNS, LABEL_COLUMN)


def assert_no_leakage(features: DataFrame) -> DataFrame:
    """Fail if a label-leaking column is present. Looks at the schema only."""
    present = sorted(set(FORBIDDEN_COLUMNS) & {c.lower() for c in features.columns})
    if present:
        raise ValueError(f"label-leaking columns in the features: {', '.join(present)}")
    return features


def split_roles(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, features, label) as three projections."""
    other = {*ID_COLUMNS, LABEL_COLUMN}
    return (
        features.select(*ID_COLUMNS),
        features.select(*[c for c in features.columns if c not in other]),
        features.select(LABEL_COLUMN),
    )
