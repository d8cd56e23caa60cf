"""A panel refreshed for late rows equals one built anew, and dates that no row touches stay as they are."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as contract
from patronlens.operators import panel
from patronlens.plans import incremental

ORDERS = "customer_id long, invoice_no string, invoice_date timestamp_ntz, is_cancelled boolean, total_revenue double"
SPANS = "customer_id long, first_snapshot timestamp_ntz, last_snapshot timestamp_ntz"
MONTHS = [datetime(2023 + m // 12, m % 12 + 1, 1) for m in range(18)]


def spans(spark, rows):
    return spark.createDataFrame(rows, SPANS)


@pytest.fixture(scope="module")
def nothing(spark):
    orders = spark.createDataFrame([], ORDERS)
    dated = spark.createDataFrame([], "customer_id long, snapshot_date timestamp_ntz")
    return orders, dated


def test_an_order_touches_the_snapshots_that_count_it(spark, nothing):
    whole = spans(spark, [(1, MONTHS[0], MONTHS[-1])])
    late = spark.createDataFrame([(1, "a", datetime(2023, 9, 15, 8), False, 1.0)], ORDERS)
    touched = panel.touched_dates(whole, whole, late, nothing[1], nothing[1])
    day = datetime(2023, 9, 15, 12)
    assert touched == [m for m in MONTHS if day - timedelta(days=90) <= m <= day + timedelta(days=180)]


def test_events_and_moved_spans_touch_their_dates(spark, nothing):
    before = spans(spark, [(1, MONTHS[4], MONTHS[9]), (2, MONTHS[5], MONTHS[9])])
    now = spans(spark, [(1, MONTHS[2], MONTHS[9]), (2, MONTHS[5], MONTHS[9])])
    seen = spark.createDataFrame([(2, MONTHS[7])], "customer_id long, snapshot_date timestamp_ntz")
    assert panel.touched_dates(before, now, nothing[0], seen, nothing[1]) == [MONTHS[2], MONTHS[3], MONTHS[4], MONTHS[7]]
    assert panel.touched_dates(now, now, nothing[0], nothing[1], nothing[1]) == []
    more = spans(spark, [(1, MONTHS[2], MONTHS[9]), (2, MONTHS[5], MONTHS[9]), (3, MONTHS[8], MONTHS[9])])
    assert panel.touched_dates(now, more, nothing[0], nothing[1], nothing[1]) == [MONTHS[8], MONTHS[9]]


def test_other_dates_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "panel")
    schema = "customer_id long, snapshot_date timestamp_ntz, x int"
    first = spark.createDataFrame([(c, m, 1) for c in range(3) for m in MONTHS[:4]], schema)
    incremental.write_panel(first, path)
    files = {f.name for f in (tmp_path / "panel").glob("snapshot_date=2023-01*/*.parquet")}
    incremental.write_panel(spark.createDataFrame([(7, MONTHS[1], 2), (7, MONTHS[5], 2)], schema), path)
    rows = {(r.customer_id, r.snapshot_date, r.x) for r in incremental.read_panel(spark, path, first).collect()}
    assert rows == {(c, m, 1) for c in range(3) for m in (MONTHS[0], MONTHS[2], MONTHS[3])} | {(7, MONTHS[1], 2), (7, MONTHS[5], 2)}
    assert {f.name for f in (tmp_path / "panel").glob("snapshot_date=2023-01*/*.parquet")} == files
    # a grid that shrank drops its dates
    incremental._drop_dates_outside(spark, path, spans(spark, [(1, MONTHS[1], MONTHS[3])]))
    left = {r.snapshot_date for r in incremental.read_panel(spark, path, first).collect()}
    assert left == {MONTHS[1], MONTHS[2], MONTHS[3]}


def test_other_queries_load_without_packages_of_the_training_data(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("patronlens.llm", "corpus_pipeline", "ahocorasick"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    names = set(contract.queries())
    assert "churn_feature_panel" in names and set(contract.oracle_sql()) <= names
