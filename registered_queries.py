"""The registered queries: each builds its result from the test tables, end to end."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.functions.dates import months, parse_timestamp, timestamp_text
from patronlens.functions.values import lower_names
from patronlens.operators import (
    attribution,
    core,
    evaluation,
    offers,
    panel,
    quality,
    reporting,
    scoring,
    training,
)
from patronlens.plans import churn, incremental, retention
from patronlens.plans.warehouse import LAYERS, RawInputs, Warehouse, publish_all
from patronlens.schemas import RAW_EVENTS
from patronlens.session import FILE_COMPRESSION, size_shuffles
from patronlens.sources import bindings, invoices, storage
from patronlens.sources.bindings import TestTables
from patronlens.sources.storage import stash

# The test events start after the month a 60-month grid ends, so queries that need
# events use the whole grid within the bounds; ``snapshot_dates`` keeps 60.
WHOLE_GRID = None

# the large tables behind the raw inputs and the proposals
SIZING_TABLES = ("customer", "orders", "lineitem", "part", "events", "documents")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _tables(spark: SparkSession, folder: str) -> TestTables:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_COMPRESSION)
    tables = TestTables(spark, folder)
    size_shuffles(spark, [tables.path(t) for t in SIZING_TABLES])
    return tables


class BoundInputs:
    """The raw inputs of one folder of test tables; each is bound when a query needs it."""

    def __init__(self, tables: TestTables):
        self.tables = tables

    @cached_property
    def invoices(self) -> DataFrame:
        return bindings.raw_invoices(self.tables)

    @cached_property
    def events(self) -> DataFrame:
        return bindings.raw_events(self.tables)

    @cached_property
    def tickets(self) -> DataFrame:
        return bindings.raw_support_tickets(self.tables)


def _warehouse(
    spark: SparkSession, folder: str, max_months: int | None = WHOLE_GRID, store_lines: bool = False
) -> Warehouse:
    return Warehouse(BoundInputs(_tables(spark, folder)), max_months, store_lines)


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def _warehouse_query(
    name: str,
    build: Callable[[Warehouse], DataFrame],
    max_months: int | None = WHOLE_GRID,
    store_lines: bool = False,
) -> None:
    _QUERIES[name] = lambda spark, folder: build(_warehouse(spark, folder, max_months, store_lines))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- raw, staging, core ----------------------------------------------------------------------

_warehouse_query("raw_invoices", lambda w: w.raw.invoices)
_warehouse_query("raw_events", lambda w: w.raw.events)
_warehouse_query("raw_support_tickets", lambda w: w.raw.tickets)
_warehouse_query("stg_invoices", lambda w: w.stg_invoices)
_warehouse_query("stg_events", lambda w: w.stg_events)
_warehouse_query("stg_support_tickets", lambda w: w.stg_support_tickets)
_warehouse_query("fct_order_lines", lambda w: w.fct_order_lines)
# a single consumer needs no stored intermediate
_warehouse_query("fct_orders", lambda w: core.orders(core.invoice_totals(w.fct_order_lines)))
_warehouse_query("dim_customers", lambda w: core.customers(core.invoice_totals(w.fct_order_lines)))
_warehouse_query("completed_orders", lambda w: core.completed(core.invoice_totals(w.fct_order_lines)))
_warehouse_query("dim_products", lambda w: w.dim_products)

# --- panel -----------------------------------------------------------------------------------

_warehouse_query(
    "snapshot_bounds", lambda w: panel.snapshot_bounds(core.invoice_totals(w.fct_order_lines))
)
_warehouse_query("snapshot_dates", lambda w: w.customer_snapshot_dates, max_months=60)
_warehouse_query("snapshot_dates_long", lambda w: w.customer_snapshot_dates)
_warehouse_query("panel_order_features", lambda w: panel.order_features(w.customer_spans, w.fct_orders))
_warehouse_query("panel_event_features", lambda w: panel.event_features(w.customer_spans, w.stg_events))
_warehouse_query(
    "panel_ticket_features", lambda w: panel.ticket_features(w.customer_spans, w.stg_support_tickets)
)
_warehouse_query("churn_feature_panel", lambda w: w.churn_feature_panel)
_warehouse_query("churn_features", lambda w: panel.assert_no_leakage(w.churn_features))



@query
def incremental_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel built without the newest months of raw rows, then refreshed when these arrive late."""
    whole = BoundInputs(_tables(spark, folder))
    raw = RawInputs(stash(whole.invoices, "invoices"), stash(whole.events, "events"), stash(whole.tickets, "tickets"))
    newest = raw.invoices.agg(F.max(parse_timestamp(F.col("InvoiceDate")))).scalar() - months(2)
    last_events = raw.events.agg(F.max("snapshot_date")).scalar()
    is_late = {
        "invoices": F.coalesce(parse_timestamp(F.col("InvoiceDate")) >= newest, F.lit(False)),
        "events": F.coalesce(F.col("snapshot_date") >= last_events, F.lit(False)),
        "tickets": F.coalesce(F.col("snapshot_date") >= last_events, F.lit(False)),
    }
    late = RawInputs(**{n: getattr(raw, n).filter(c) for n, c in is_late.items()})
    before = Warehouse(RawInputs(**{n: getattr(raw, n).filter(~c) for n, c in is_late.items()}), WHOLE_GRID)
    now, path = Warehouse(raw, WHOLE_GRID), storage.scratch_path(spark, "panel")
    incremental.write_panel(before.churn_feature_panel, path)
    incremental.refresh_panel(path, before, now, late)
    return incremental.read_panel(spark, path, now.churn_feature_panel)


# --- marts -----------------------------------------------------------------------------------

_warehouse_query("customer_360", lambda w: w.mart_customer_360)
_warehouse_query("rfm_segments", lambda w: w.mart_rfm_segments)
_warehouse_query("customer_profile", lambda w: w.customer_profile)


# --- split and evaluation on the fixed score -------------------------------------------------


def _scores(orders_only: DataFrame) -> DataFrame:
    scored = bindings.fixed_score(orders_only)
    label = (F.lit(1) - F.col("has_future_order")).alias("churned_next_90d")
    return scored.select("customer_id", "snapshot_date", "churn_probability", label)


class Scored:
    """The panel with the fixed score, and predictions from it, for one set of tables."""

    def __init__(self, spark: SparkSession, folder: str, store_lines: bool = False):
        self.spark, self.tables = spark, _tables(spark, folder)
        self.warehouse = _warehouse(spark, folder, store_lines=store_lines)

    @cached_property
    def panel_scores(self) -> DataFrame:
        """Score and label of every panel row; only order features are needed for them."""
        w = self.warehouse
        return _scores(panel.order_features(w.customer_spans, w.fct_orders))

    @cached_property
    def predictions(self) -> DataFrame:
        """Of the newest panel row of each customer; no other is built."""
        stamp = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
        spans, dates = self.warehouse.newest_spans
        newest = _scores(panel.order_features(spans, self.warehouse.fct_orders, dates))
        return scoring.with_risk_bands(stash(scoring.latest_snapshot(newest), "latest"), stamp)

    @cached_property
    def profiles(self) -> DataFrame:
        return stash(self.warehouse.customer_profile, "profiles")

    @cached_property
    def products(self) -> DataFrame:
        return self.warehouse.dim_products

    @cached_property
    def proposals(self) -> DataFrame:
        return bindings.proposals(self.tables)

    @cached_property
    def checked(self) -> DataFrame:
        return offers.check_offers(self.proposals, self.products)

    @cached_property
    def dashboard(self) -> DataFrame:
        w = self.warehouse
        return reporting.dashboard_predictions(self.predictions, w.mart_customer_360, w.mart_rfm_segments)

    @cached_property
    def run(self) -> retention.RetentionRun:
        return retention.retention_run(self.predictions, self.profiles, self.proposals, self.products)

    @cached_property
    def explanations(self) -> DataFrame:
        latest = scoring.latest_snapshot(self.warehouse.newest_features)
        return bindings.fixed_score(latest).select(
            "customer_id",
            "snapshot_date",
            "churn_probability",
            attribution.top_features(bindings.fixed_impacts()).alias("top_features"),
        )


def _dates_as_timestamps(df: DataFrame) -> DataFrame:
    """DATE columns as midnight timestamps, which every client compares alike."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "date" else F.col(c) for c in df.columns]
    )


def _scored_query(name: str, build: Callable[[Scored], DataFrame], store_lines: bool = False) -> None:
    _QUERIES[name] = lambda spark, folder: _dates_as_timestamps(build(Scored(spark, folder, store_lines)))


_warehouse_query("time_split_summary", lambda w: evaluation.time_split_summary(w.churn_features))
_warehouse_query("label_balance", lambda w: evaluation.label_balance(w.churn_features))
_warehouse_query(
    "class_weight", lambda w: evaluation.class_weight(evaluation.time_split(w.churn_features)[0])
)
_scored_query("roc_auc", lambda s: evaluation.roc_auc(s.panel_scores))
_scored_query("classification_report", lambda s: evaluation.classification_report(s.panel_scores))
_scored_query(
    "calibration_table", lambda s: evaluation.calibration_table(stash(s.panel_scores, "panel-scores"))
)

# --- scoring ---------------------------------------------------------------------------------

_warehouse_query("latest_snapshot", lambda w: scoring.latest_snapshot(w.churn_features))
_scored_query("risk_bands", lambda s: s.predictions)
_scored_query(
    "risk_band_distribution",
    lambda s: s.predictions.groupBy("risk_band").agg(F.count(F.lit(1)).alias("n_customers")),
)
_scored_query("high_risk_customers", lambda s: scoring.by_risk(scoring.high_risk(s.predictions)))
_scored_query("high_risk_top_n", lambda s: scoring.by_risk(scoring.high_risk(s.predictions), 5))
_scored_query("highest_risk_row", lambda s: scoring.by_risk(s.panel_scores, 1))
_scored_query("score_lookup", lambda s: reporting.score_lookup(s.warehouse.dim_customers, s.predictions))

# --- offers ----------------------------------------------------------------------------------


def _purchased(w: Warehouse) -> DataFrame:
    return offers.purchased_products(w.fct_order_lines, w.dim_products)


def _all_candidates(w: Warehouse) -> DataFrame:
    purchased = stash(_purchased(w), "purchased")
    fallback = offers.fallback_products(w.dim_customers, purchased, w.dim_products)
    return offers.candidate_products(purchased).unionByName(fallback)


_warehouse_query(
    "candidate_products", lambda w: offers.candidate_products(_purchased(w)), store_lines=True
)
_warehouse_query(
    "candidate_products_fallback",
    lambda w: offers.fallback_products(w.dim_customers, _purchased(w), w.dim_products),
    store_lines=True,
)
_scored_query(
    "offer_context",
    lambda s: offers.offer_context(s.profiles, s.explanations, _all_candidates(s.warehouse)),
    store_lines=True,
)
_scored_query(
    "offer_context_feedback",
    lambda s: offers.offer_context(
        s.profiles,
        s.explanations,
        _all_candidates(s.warehouse),
        offers.rejected(s.checked).filter("attempt = 1").select("customer_id", "reasons"),
    ),
    store_lines=True,
)


def _answers(s: Scored):
    """The test proposals in the role of a generator: those of the requested customers and attempt."""
    def answer(requests: DataFrame, attempt: int) -> DataFrame:
        own = s.proposals.filter(F.col("attempt") == attempt)
        return own.join(requests.select("customer_id"), "customer_id", "left_semi").select("customer_id", "payload")

    return answer


def _contexts(s: Scored) -> DataFrame:
    return offers.offer_context(s.profiles, s.explanations, _all_candidates(s.warehouse))


_scored_query(
    "retry_requests",
    lambda s: retention.retry_rounds(_contexts(s), _answers(s), s.products).requests,
    store_lines=True,
)
_scored_query(
    "retention_outcomes",
    lambda s: retention.run_with_retries(
        s.predictions, s.profiles, s.explanations, _all_candidates(s.warehouse), _answers(s), s.products
    ),
    store_lines=True,
)
_scored_query("validated_offers", lambda s: offers.accepted(s.checked))
_scored_query(
    "rejected_offers",
    lambda s: offers.rejected(s.checked).withColumn("reasons", F.concat_ws(",", "reasons")),
)
_scored_query(
    "valid_product_focus",
    lambda s: offers.valid_product_focus(
        offers.parse_proposals(s.proposals).select("customer_id", "attempt", "product_focus"), s.products
    ),
)
_scored_query("first_valid_attempt", lambda s: offers.first_valid(offers.accepted(s.checked)))
_scored_query("unprofiled_high_risk", lambda s: retention.unprofiled_high_risk(s.predictions, s.profiles))
_scored_query(
    "intervention_outcomes", lambda s: retention.outcome_counts(s.run.outcomes), store_lines=True
)
_scored_query("interventions", lambda s: s.run.interventions, store_lines=True)

# --- reports ---------------------------------------------------------------------------------

_scored_query("dashboard_predictions", lambda s: s.dashboard)
_scored_query(
    "kpi_summary",
    lambda s: reporting.kpi_summary(s.predictions, s.run.interventions),
    store_lines=True,
)
_scored_query("filter_options", lambda s: reporting.filter_options(s.dashboard))
_scored_query("risk_table", lambda s: reporting.risk_table(s.dashboard))
_scored_query(
    "risk_table_filtered",
    lambda s: reporting.risk_table(s.dashboard, ["champions", "at_risk"], ["high", "medium"]),
)
_scored_query("profile_display", lambda s: reporting.profile_display(s.warehouse.customer_profile))
_scored_query("explanation_table", lambda s: reporting.explanation_table(s.explanations))

# --- data quality ----------------------------------------------------------------------------


def quality_tables(w: Warehouse) -> dict[str, DataFrame]:
    """The checked tables, each stored once as the checks read it several times."""
    panel_table = stash(w.churn_feature_panel, "panel")
    return {
        "raw_invoices": w.raw.invoices,
        "raw_events": w.raw.events,
        "raw_support_tickets": w.raw.tickets,
        "stg_invoices": w.stg_invoices,
        "stg_events": w.stg_events,
        "stg_support_tickets": w.stg_support_tickets,
        "fct_order_lines": w.fct_order_lines,
        "fct_orders": w.fct_orders,
        "dim_customers": w.dim_customers,
        "customer_snapshot_dates": w.customer_snapshot_dates,
        "churn_feature_panel": panel_table,
        "dim_products": w.dim_products,
        "mart_customer_360": w.mart_customer_360,
        "mart_rfm_segments": w.mart_rfm_segments,
        "churn_features": panel.churn_features(panel_table),
    }


_warehouse_query("dq_report", lambda w: quality.quality_report(quality_tables(w)), store_lines=True)

# --- ingestion and storage -------------------------------------------------------------------


@query
def shift_years(spark: SparkSession, folder: str) -> DataFrame:
    t = _tables(spark, folder)
    return bindings.shifted_orders(t).select("o_orderkey", timestamp_text(F.col("o_orderdate")).alias("shifted"))


@query
def raw_union(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices written as one CSV location per sheet, then scanned and united again."""
    raw = stash(bindings.raw_invoices(_tables(spark, folder)), "raw-invoices")
    paths = {}
    for sheet in ("a", "b"):
        paths[sheet] = storage.scratch_path(spark, f"sheet-{sheet}")
        rows = raw.filter(F.col("source_sheet") == sheet).drop("source_sheet")
        rows.write.csv(paths[sheet], header=True, escape='"')
    return invoices.read_invoice_csvs(spark, paths)


@query
def ingested_invoices(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ingest of CSV sheets with different column orders and line ends in texts.

    Strict parsing fails on a text that is no date, so the test rows that hold one are left out.
    """
    raw = bindings.raw_invoices(_tables(spark, folder)).filter("InvoiceDate <> 'not-a-date'")
    raw = stash(raw.withColumn("Description", F.replace("Description", F.lit(" "), F.lit("\n"))), "raw-invoices")
    paths, columns = {}, [c for c in raw.columns if c != "source_sheet"]
    for sheet, order in (("a", columns), ("b", columns[::-1])):
        paths[sheet] = storage.scratch_path(spark, f"sheet-{sheet}")
        raw.filter(F.col("source_sheet") == sheet).select(order).write.csv(paths[sheet], header=True, escape='"')
    return invoices.load_invoices(spark, paths, bindings.TARGET_YEAR)


@query
def landed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events landed under their fixed key and scanned with the declared schema."""
    events = bindings.raw_events(_tables(spark, folder))
    path = storage.land_raw(events, storage.scratch_path(spark, "landing"), "raw_events")
    return storage.read_parquet(spark, path, RAW_EVENTS)


def _stored_predictions(s: Scored) -> DataFrame:
    """The predictions table after its rows were replaced twice."""
    storage.write_predictions(s.predictions.limit(0))
    return s.spark.table(storage.write_predictions(s.predictions))


def _stored_interventions(s: Scored) -> DataFrame:
    """The interventions after the same batch was appended twice, as by a repeated run."""
    path = storage.scratch_path(s.spark, "interventions")
    storage.create_interventions(s.spark, path)
    stamp = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    for _ in range(2):
        storage.append_interventions(s.run.interventions.withColumn("generated_at", stamp), path, "run-1")
    return storage.read_interventions(s.spark, path)


_scored_query("stored_predictions", _stored_predictions)
_scored_query("stored_interventions", _stored_interventions, store_lines=True)



@query
def published_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every table after publishing all layers, read back by name."""
    whole = BoundInputs(_tables(spark, folder))
    with storage.settings(spark, storage.SPARE_DISK):
        # the joins' shuffles are gone before the lines are shuffled, and the raw lines once these are stored
        lines = stash(whole.invoices, "raw-invoices")
        warehouse = Warehouse(RawInputs(lines, whole.events, whole.tickets), WHOLE_GRID, store_lines=True)
        warehouse.stg_invoices  # stores them
        storage.discard(lines)
    names = publish_all(warehouse)
    counts = [
        storage.read_published(spark, LAYERS[t], t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        for t in names
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def lowered_names(spark: SparkSession, folder: str) -> DataFrame:
    """Raw invoices under lower-case column names."""
    return lower_names(bindings.raw_invoices(_tables(spark, folder)))


_warehouse_query("feature_columns", lambda w: panel.split_roles(panel.assert_no_leakage(w.churn_features))[1])

# --- model -----------------------------------------------------------------------------------


def _stored_features(spark: SparkSession, folder: str) -> DataFrame:
    return stash(panel.assert_no_leakage(_warehouse(spark, folder).churn_features), "features")


@query
def train_report(spark: SparkSession, folder: str) -> DataFrame:
    return churn.train_and_evaluate(_stored_features(spark, folder))[1]


@query
def model_predictions(spark: SparkSession, folder: str) -> DataFrame:
    features = _stored_features(spark, folder)
    model = training.train(evaluation.time_split(features)[0])
    return churn.score_latest(model, features)


@query
def explanations(spark: SparkSession, folder: str) -> DataFrame:
    features = _stored_features(spark, folder)
    model = training.train(evaluation.time_split(features)[0])
    return churn.explain_latest(model, features)


@query
def model_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for any model: customers scored, and rows that break a rule (none).

    The model is stored and loaded again; both score the latest snapshots, and the
    explanation of every score must add up to its log-odds.
    """
    features = _stored_features(spark, folder)
    model = training.train(evaluation.time_split(features)[0])
    path = storage.scratch_path(spark, "model")
    training.save_model(model, path)
    loaded = training.load_model(path)
    latest = stash(scoring.latest_snapshot(features), "latest")
    parts = attribution.attribute(loaded, latest)
    impacts = [F.col(c) for c in parts.columns if c.startswith("impact_")]
    summed = parts.select("customer_id", sum(impacts, F.col("base_value")).alias("summed"))
    first = training.predict(model, latest).select("customer_id", F.col("churn_probability").alias("p"))
    again = training.predict(loaded, latest).select("customer_id", F.col("churn_probability").alias("again"))
    rows = first.join(again, "customer_id", "full").join(summed, "customer_id", "full")
    p = F.col("p")
    broken = {
        "probability_out_of_range": p.isNull() | (p < 0) | (p > 1),
        "loaded_model_differs": ~p.eqNullSafe(F.col("again")),
        "impacts_off_log_odds": F.coalesce(F.abs(F.log(p / (1 - p)) - F.col("summed")) > 1e-6, F.lit(True)),
    }
    counts = {"scored_customers": F.count(F.lit(1))} | {n: F.count(F.when(c, 1)) for n, c in broken.items()}
    totals = rows.agg(*[c.alias(n) for n, c in counts.items()])
    entries = [F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in counts]
    return totals.select(F.inline(F.array(*entries)))


@query
def explain_report(spark: SparkSession, folder: str) -> DataFrame:
    """Profile, explanation and offer of every customer in full, with the status of each."""
    s = Scored(spark, folder, store_lines=True)
    plans = offers.first_valid(offers.accepted(s.checked))
    report = reporting.explain_report(
        s.warehouse.dim_customers, offers.profile_json(s.profiles), offers.explanation_json(s.explanations), plans
    )
    return report.select(
        "customer_id",
        "status",
        F.col("profile.profile_json").alias("profile_json"),
        F.col("explanation.explanation_json").alias("explanation_json"),
        *[
            F.col(f"retention_plan.{c}").alias(c)
            for c in ("offer_customer_id", "attempt", "discount_pct", "channel", "product_focus", "messaging")
        ],
    )
