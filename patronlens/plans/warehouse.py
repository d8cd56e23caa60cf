"""All warehouse tables over one set of raw inputs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property
from math import ceil

from pyspark.sql import DataFrame

from patronlens.fixed_values import MAX_MONTHS
from patronlens.operators import core, marts, panel, quality, staging
from patronlens.session import shuffle_partitions
from patronlens.sources.storage import (
    CONCURRENT_WRITERS,
    SPARE_DISK,
    TABLE_LAYERS,
    clustered,
    discard,
    lookup_options,
    publish,
    settings,
    stash,
)


@dataclass(frozen=True)
class RawInputs:
    invoices: DataFrame
    events: DataFrame
    tickets: DataFrame


class Warehouse:
    """Each table is a lazy DataFrame, built on first use.

    ``invoice_totals`` feeds orders, customers and everything after them, so it is
    written once to the shared folder and the later tables scan it, as are the customers'
    spans, from which the panel takes its rows and its number of tasks. With
    ``store_lines`` the staged lines, the products, the customers and their order figures
    are written too; use it when products or purchases are needed next to the orders. The
    lines stay dealt out by invoice and customer, so their totals need no shuffle.
    """

    def __init__(self, raw: RawInputs, max_months: int | None = MAX_MONTHS, store_lines: bool = False):
        self.raw, self.max_months, self.store_lines = raw, max_months, store_lines

    @cached_property
    def stg_invoices(self) -> DataFrame:
        raw = self.raw.invoices
        if not self.store_lines:
            return staging.stage_invoices(raw)
        tasks = shuffle_partitions(raw.sparkSession)
        return stash(staging.stage_invoices(raw, tasks), "stg-invoices", (tasks, staging.INVOICE_KEY))

    @cached_property
    def stg_events(self) -> DataFrame:
        return staging.stage_events(self.raw.events)

    @cached_property
    def stg_support_tickets(self) -> DataFrame:
        return staging.stage_tickets(self.raw.tickets)

    @cached_property
    def fct_order_lines(self) -> DataFrame:
        return core.order_lines(self.stg_invoices)

    @cached_property
    def invoice_totals(self) -> DataFrame:
        return stash(core.invoice_totals(self.fct_order_lines), "invoice-totals")

    @cached_property
    def fct_orders(self) -> DataFrame:
        return core.orders(self.invoice_totals)

    @cached_property
    def dim_customers(self) -> DataFrame:
        customers = core.customers(self.invoice_totals)
        return stash(customers, "customers") if self.store_lines else customers

    @cached_property
    def order_stats(self) -> DataFrame | None:
        """The figures that both marts take from the orders, if they are stored."""
        return stash(marts.completed_order_stats(self.fct_orders), "order-stats") if self.store_lines else None

    @cached_property
    def dim_products(self) -> DataFrame:
        products = core.products(self.fct_order_lines)
        return stash(products, "products") if self.store_lines else products

    @cached_property
    def customer_spans(self) -> DataFrame:
        return stash(panel.customer_spans(self.fct_orders, self.dim_customers, self.max_months), "customer-spans")

    @cached_property
    def customer_snapshot_dates(self) -> DataFrame:
        return panel.snapshot_dates(self.customer_spans)

    @cached_property
    def churn_feature_panel(self) -> DataFrame:
        return panel.feature_panel(
            self.customer_spans, self.fct_orders, self.stg_events, self.stg_support_tickets
        )

    @cached_property
    def churn_features(self) -> DataFrame:
        return panel.churn_features(self.churn_feature_panel)

    @cached_property
    def newest_spans(self) -> tuple[DataFrame, list[datetime] | None]:
        return panel.newest(self.customer_spans)

    @cached_property
    def newest_features(self) -> DataFrame:
        """``churn_features`` at the last snapshot of each customer; no other customer month is built."""
        spans, dates = self.newest_spans
        return panel.churn_features(
            panel.feature_panel(spans, self.fct_orders, self.stg_events, self.stg_support_tickets, dates)
        )

    @cached_property
    def mart_customer_360(self) -> DataFrame:
        return marts.customer_360(self.fct_orders, self.dim_customers, self.order_stats)

    @cached_property
    def mart_rfm_segments(self) -> DataFrame:
        return marts.rfm_segments(self.fct_orders, stats=self.order_stats)

    @cached_property
    def customer_profile(self) -> DataFrame:
        return marts.customer_profile(self.mart_customer_360, self.mart_rfm_segments)


LAYERS = {
    "stg_invoices": "stg",
    "stg_events": "stg",
    "stg_support_tickets": "stg",
    "fct_order_lines": "core",
    "fct_orders": "core",
    "dim_customers": "core",
    "dim_products": "core",
    "customer_snapshot_dates": "core",
    "churn_feature_panel": "core",
    "mart_customer_360": "marts",
    "mart_rfm_segments": "marts",
    "churn_features": "features",
}
PARTITIONING = {"churn_feature_panel": ["snapshot_date"]}
# one row per customer each; joins between them need no shuffle
CLUSTERED = {"dim_customers", "mart_customer_360", "mart_rfm_segments"}
# stored steps that no table after this one reads
LAST_READER = {"dim_customers": "invoice_totals"}
# A task writes so many grouping tasks' rows of the panel, with a file for each date; without sorting them, up to so many dates.
GROUPINGS_PER_WRITER, OPEN_DATES = 8, 128


def _few_writers(rows: DataFrame, months: int) -> DataFrame:
    """The panel's rows in fewer tasks: a date has a file of each, and small files are mostly footers.

    Such a task groups one part after the other, so its hash map doesn't grow.
    """
    enough = 3 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(enough, ceil(months / (GROUPINGS_PER_WRITER * panel.GROUPS_PER_TASK))))


def publish_all(warehouse: Warehouse, buckets: int | None = None) -> dict[str, str]:
    """Publish every table to its layer and return the names.

    After a table is written, later tables read the written copy, and what the warehouse had
    stored of it, or for it alone, is deleted. The lines are bucketed by invoice and customer, so
    their totals need no shuffle. A table whose rows fail a not_null or accepted_values check of
    severity ``error``, counted during the write, isn't switched to. ``buckets`` is the number of
    files of tables by customer (default: the session's shuffle partitions).
    """
    spark = warehouse.raw.invoices.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = {}
    with settings(spark, SPARE_DISK | {CONCURRENT_WRITERS: str(OPEN_DATES)}):
        for table, layer in LAYERS.items():
            own = df = getattr(warehouse, table)
            by = options = verify = None
            if table in CLUSTERED:
                df, by = clustered(df, buckets)
                options = lookup_options("customer_id")
            if table == "fct_order_lines":
                by = shuffle_partitions(spark), staging.INVOICE_KEY
            if table in PARTITIONING:
                df = _few_writers(df, warehouse.customer_snapshot_dates.count())
            if layer in TABLE_LAYERS:
                df, verify = quality.watched(df, [c for c in quality.STANDARD_CHECKS if c.table == table])
            names[table] = publish(df, layer, table, PARTITIONING.get(table), by, verify, options)
            warehouse.__dict__[table] = spark.table(names[table])
            spent = warehouse.__dict__.pop(LAST_READER[table], None) if table in LAST_READER else None
            for stored in (spent, own if layer in TABLE_LAYERS else None):
                if stored is not None and "stash_path" in stored.__dict__:
                    discard(stored)
    return names
