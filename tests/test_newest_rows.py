"""Queries on the newest row of each customer build no other customer month."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import registered_queries
from patronlens.operators import panel, scoring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    return registered_queries.Scored(spark, SF)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_explanations_and_predictions_build_only_the_newest_rows(spark):
    scored = registered_queries.Scored(spark, SF)
    assert scored.explanations.count() == scored.predictions.count() > 10
    built = {*vars(scored), *vars(scored.warehouse)}
    assert not built & {"panel_scores", "churn_feature_panel", "churn_features"}


def test_the_newest_rows_are_those_of_the_whole_panel(scored):
    w = scored.warehouse
    assert w.newest_features.count() > 10
    assert same(w.newest_features, scoring.latest_snapshot(w.churn_features))
    newest = scoring.latest_snapshot(scored.panel_scores).select("customer_id", F.col("snapshot_date").cast("date"), "churn_probability")
    assert same(scored.predictions.select(newest.columns), newest)


def test_spans_that_end_apart(scored):
    """One customer has its last snapshot years before the others, one a month before."""
    w = scored.warehouse
    early = F.when(F.col("customer_id") % 3 == 0, F.col("first_snapshot")).when(
        F.col("customer_id") % 3 == 1, F.greatest("first_snapshot", F.col("last_snapshot") - F.expr("INTERVAL 1 MONTH"))
    )
    spans = w.customer_spans.withColumn("last_snapshot", F.coalesce(early, "last_snapshot"))
    inputs = w.fct_orders, w.stg_events, w.stg_support_tickets
    cut, dates = panel.newest(spans)
    assert len(dates) > 1
    assert same(panel.feature_panel(cut, *inputs, dates), scoring.latest_snapshot(panel.feature_panel(spans, *inputs)))
    assert same(panel.order_features(cut, inputs[0], dates), scoring.latest_snapshot(panel.order_features(spans, inputs[0])))


def test_no_spans(scored):
    w = scored.warehouse
    cut, dates = panel.newest(w.customer_spans.limit(0))
    assert dates is None
    assert panel.order_features(cut, w.fct_orders, dates).count() == 0


@pytest.mark.parametrize("date", [datetime(2023, 6, 1)])
def test_one_date_of_the_panel_has_the_rows_of_the_whole(scored, date):
    w = scored.warehouse
    inputs = w.customer_spans, w.fct_orders, w.stg_events, w.stg_support_tickets
    whole = panel.feature_panel(*inputs).filter(F.col("snapshot_date") == F.lit(date).cast("timestamp_ntz"))
    assert whole.count() > 10
    assert same(panel.feature_panel(*inputs, [date]), whole)
