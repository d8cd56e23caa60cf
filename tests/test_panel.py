from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patronlens.functions.dates import days
from patronlens.operators import panel
from patronlens.schemas import RAW_EVENTS, RAW_TICKETS

S = datetime(2024, 5, 1)
DAY, SECOND = timedelta(days=1), timedelta(seconds=1)
ORDERS = (
    "invoice_no string, customer_id long, invoice_date timestamp_ntz, country string, "
    "is_cancelled boolean, total_quantity long, total_revenue double, line_count long"
)


def orders_of(spark, rows):
    """rows: (customer, date, cancelled, revenue)"""
    return spark.createDataFrame(
        [(str(i), c, d, "X", x, 1, r, 1) for i, (c, d, x, r) in enumerate(rows)], ORDERS
    )


def spans_of(spark, *customers, snapshot=S):
    return spark.createDataFrame(
        [(c, snapshot, snapshot) for c in customers],
        "customer_id long, first_snapshot timestamp_ntz, last_snapshot timestamp_ntz",
    )


EDGES = {
    1: S - 180 * DAY,
    2: S - 180 * DAY + SECOND,
    3: S - 90 * DAY,
    4: S - 90 * DAY + SECOND,
    5: S,
    6: S + SECOND,
    7: S + 90 * DAY,
    8: S + 90 * DAY + SECOND,
}
# customer: (days_since, frequency, recent, prior, invoices, future)
DONE = {
    1: (180, 0, 0, 0, 0, 0),
    2: (180, 1, 0, 1, 0, 0),
    3: (90, 1, 0, 1, 0, 0),
    4: (90, 1, 1, 0, 1, 0),
    5: (0, 1, 1, 0, 1, 0),
    6: (None, 0, 0, 0, 0, 1),
    7: (None, 0, 0, 0, 0, 1),
    8: (None, 0, 0, 0, 0, 0),
}


@pytest.mark.parametrize("cancelled", [False, True])
def test_order_windows(spark, cancelled):
    orders = orders_of(spark, [(c, d, cancelled, 10.0) for c, d in EDGES.items()])
    rows = {r["customer_id"]: r for r in panel.order_features(spans_of(spark, *EDGES), orders).collect()}
    assert len(rows) == 8
    for c, (since, frequency, recent, prior, invoices, future) in DONE.items():
        r = rows[c]
        assert r["total_invoices_90d"] == invoices
        assert r["cancelled_invoices_90d"] == (invoices if cancelled else 0)
        if cancelled:
            since, frequency, recent, prior, future = None, 0, 0, 0, 0
        assert r["days_since_last_order"] == since
        assert (r["frequency_180d"], r["orders_recent_90d"], r["orders_prior_90d"]) == (frequency, recent, prior)
        assert r["monetary_180d"] == (10.0 * frequency if frequency else None)
        assert r["has_future_order"] == future


def test_event_and_ticket_windows(spark):
    other = datetime(2024, 4, 1)
    times = [S - 90 * DAY, S - 90 * DAY + SECOND, S - 30 * DAY, S - 30 * DAY + SECOND, S, S + SECOND]
    events = spark.createDataFrame(
        [(f"e{i}", 1, S, t, "login") for i, t in enumerate(times)] + [("x", 1, other, S - DAY, "login")], RAW_EVENTS
    )
    row = panel.event_features(spans_of(spark, 1), events).first()
    assert (row["events_30d"], row["events_90d"]) == (2, 4)

    tickets = spark.createDataFrame(
        [(f"t{i}", 1, S, t, None, "open", "other") for i, t in enumerate(times)]
        + [("x", 1, other, S - DAY, None, "open", "other")],
        RAW_TICKETS,
    ).withColumn("resolution_days", F.when(F.col("ticket_id") == "t1", 4).when(F.col("ticket_id") == "t2", 7))
    row = panel.ticket_features(spans_of(spark, 1), tickets).first()
    assert row["support_tickets_90d"] == 4
    assert row["avg_resolution_days_90d"] == 5.5
    assert row["days_since_last_ticket"] == 0


def test_customer_without_rows(spark):
    empty = orders_of(spark, [])
    events, tickets = spark.createDataFrame([], RAW_EVENTS), spark.createDataFrame([], RAW_TICKETS)
    tickets = tickets.withColumn("resolution_days", F.lit(None).cast("int"))
    row = panel.feature_panel(spans_of(spark, 9), empty, events, tickets).first().asDict()
    counts = {"frequency_180d", "events_30d", "events_90d", "support_tickets_90d"}
    for name in counts:
        assert row.pop(name) == 0
    assert row.pop("churned_next_90d") == 1
    assert (row.pop("customer_id"), row.pop("snapshot_date")) == (9, S)
    assert set(row.values()) == {None}


def test_equals_the_range_join(spark):
    """The expand-and-group plan against the plain join of snapshots and orders."""
    start = F.lit("2022-01-01").cast("timestamp_ntz")
    orders = spark.range(3000).select(
        F.col("id").cast("string").alias("invoice_no"),
        F.expr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END").alias("customer_id"),
        (start + F.make_dt_interval(F.expr("cast(pmod(hash(id), 900) as int)"), F.expr("cast(id % 3 * 12 as int)"))).alias("invoice_date"),
        F.lit("X").alias("country"),
        F.expr("pmod(hash(id, 1), 4) = 0").alias("is_cancelled"),
        F.lit(1).cast("long").alias("total_quantity"),
        F.expr("cast(pmod(hash(id, 2), 1000) as double) / 10").alias("total_revenue"),
        F.lit(1).cast("long").alias("line_count"),
    )
    spans = orders.select("customer_id").distinct().select(
        "customer_id",
        F.lit("2022-03-01").cast("timestamp_ntz").alias("first_snapshot"),
        F.lit("2024-09-01").cast("timestamp_ntz").alias("last_snapshot"),
    )
    s, d = F.col("snapshot_date"), F.col("invoice_date")
    joined = panel.snapshot_dates(spans).join(
        orders.withColumnRenamed("customer_id", "c"),
        (F.col("c") == F.col("customer_id")) & (d >= s - days(180)) & (d <= s + days(90)),
        "left",
    )
    done, past = ~F.col("is_cancelled"), d <= s
    naive = joined.groupBy("customer_id", "snapshot_date").agg(
        F.count(F.when(done & past & (d > s - days(180)), 1)).alias("frequency_180d"),
        F.round(F.sum(F.when(done & past & (d > s - days(180)), F.col("total_revenue"))), 6).alias("monetary_180d"),
        F.count(F.when(past & (d > s - days(90)), 1)).alias("total_invoices_90d"),
        F.datediff(F.first("snapshot_date"), F.max(F.when(done & past, d))).alias("days_since_last_order"),
        F.coalesce(F.max(F.when(done & (d > s), 1)), F.lit(0)).alias("has_future_order"),
    )
    fast = panel.order_features(spans, orders).select(*naive.columns)
    assert fast.count() == naive.count() > 1000
    assert fast.exceptAll(naive).count() == 0


def test_grid_bounds(spark):
    def spans(first, last, since, **kw):
        orders = orders_of(spark, [(1, first, False, 1.0), (1, last, False, 1.0)])
        customers = spark.createDataFrame([(1, since)], "customer_id long, first_order_date timestamp_ntz")
        found = panel.snapshot_dates(panel.customer_spans(orders, customers, **kw)).collect()
        return sorted(r["snapshot_date"] for r in found)

    start, end = datetime(2022, 1, 1) - 90 * DAY, datetime(2022, 4, 1) + 90 * DAY
    # both bounds hit a month start exactly
    assert spans(start, end, start) == [datetime(2022, m, 1) for m in (1, 2, 3, 4)]
    # a second later or earlier drops it
    assert spans(start + SECOND, end - SECOND, start) == [datetime(2022, m, 1) for m in (2, 3)]
    # the customer's first order bounds the start
    assert spans(start, end, datetime(2022, 2, 1, 0, 0, 1)) == [datetime(2022, m, 1) for m in (3, 4)]
    # the cap counts from the first month, even if that month is not in the range
    assert spans(start + SECOND, end, start, max_months=2) == [datetime(2022, 2, 1)]
    assert spans(start, end, datetime(2030, 1, 1)) == []


def test_no_completed_order_gives_no_grid(spark):
    orders = orders_of(spark, [(1, S, True, 1.0)])
    customers = spark.createDataFrame([(1, S)], "customer_id long, first_order_date timestamp_ntz")
    assert panel.customer_spans(orders, customers).count() == 0


def test_leakage_guard(spark):
    good = spark.createDataFrame([(1, 2)], "customer_id long, frequency_180d long")
    assert panel.assert_no_leakage(good) is good
    with pytest.raises(ValueError, match="days_since_last_order"):
        panel.assert_no_leakage(good.withColumn("DAYS_SINCE_LAST_ORDER", F.lit(1)))


def test_roles(spark):
    df = spark.createDataFrame([(1, S, 2, 0)], "customer_id long, snapshot_date timestamp_ntz, a int, churned_next_90d int")
    ids, features, label = panel.split_roles(df)
    assert (ids.columns, features.columns, label.columns) == (["customer_id", "snapshot_date"], ["a"], ["churned_next_90d"])
