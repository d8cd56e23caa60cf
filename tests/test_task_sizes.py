"""The number of shuffle partitions follows the tables."""

from __future__ import annotations

import re

import registered_queries
from patronlens import session

FOLDER = "/root/testdata/sf0.001"


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\(invoice_no\S*, customer_id\S*, (\d+)\)", plan)]


def test_partitions_of_invoices_follow_the_files(spark, monkeypatch):
    few = shuffles(registered_queries._warehouse(spark, FOLDER).stg_invoices)
    assert few and set(few) == {8}  # never fewer than the session's
    monkeypatch.setattr(session, "INPUT_PER_PARTITION", 1 << 16)
    many = registered_queries._warehouse(spark, FOLDER)
    assert min(shuffles(many.stg_invoices)) > 8
    # and the rows are the same, in tasks that AQE merged again
    assert many.stg_invoices.count() == registered_queries._warehouse(spark, FOLDER).stg_invoices.count()


def test_missing_files_count_nothing(spark, tmp_path):
    assert session.size_shuffles(spark, [str(tmp_path / "none.parquet")]) == 8
