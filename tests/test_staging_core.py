from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from patronlens.operators import core, marts, staging
from patronlens.schemas import RAW_EVENTS, RAW_INVOICES, RAW_TICKETS
from patronlens.sources.invoices import load_invoices, shift_years

LINE = ("1", "A", "Mug", 3.0, "2024-01-05 10:00:00", 2.5, 7.0, "UK", "a")


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_INVOICES)


def with_fields(**changes):
    names = [f.name for f in RAW_INVOICES]
    return tuple(changes.get(n, v) for n, v in zip(names, LINE))


def test_duplicates_go_within_a_sheet_only(spark):
    rows = raw(spark, LINE, LINE, with_fields(source_sheet="b"))
    assert staging.stage_invoices(rows).count() == 2


def test_dirty_values(spark):
    rows = raw(
        spark,
        with_fields(InvoiceNo=None),
        with_fields(InvoiceNo="C2", Quantity=-2.5),
        with_fields(InvoiceNo="3", InvoiceDate="not-a-date", Quantity=3.7),
        with_fields(InvoiceNo="4", CustomerID=None),
    )
    got = {r["invoice_no"]: r for r in staging.stage_invoices(rows).collect()}
    assert set(got) == {None, "C2", "3"}
    assert got[None]["is_cancelled"] is False
    assert got["C2"]["is_cancelled"] is True and got["C2"]["quantity"] == -3
    assert got["3"]["invoice_date"] is None and got["3"]["quantity"] == 4


@pytest.mark.parametrize("text, expected", [("3.7", 4), ("2.5", 3), ("-2.5", -3), ("7", 7), (None, None)])
def test_text_and_double_quantities_round_alike(spark, text, expected):
    rows = raw(spark, with_fields(Quantity=None if text is None else float(text)))
    as_text = rows.withColumn("Quantity", F.lit(text).cast("string"))
    for df in (rows, as_text):
        assert staging.stage_invoices(df).first()["quantity"] == expected


def test_garbage_quantity_is_an_error(spark):
    rows = raw(spark, LINE).withColumn("Quantity", F.lit("many"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        staging.stage_invoices(rows).collect()


def test_events_and_tickets_need_a_customer(spark):
    s = datetime(2024, 2, 1)
    events = spark.createDataFrame([("e", 1, s, s, "login"), ("f", None, s, s, "login")], RAW_EVENTS)
    assert [r["event_id"] for r in staging.stage_events(events).collect()] == ["e"]
    t = datetime(2024, 1, 20, 23, 59)
    tickets = spark.createDataFrame(
        [("a", 1, s, t, datetime(2024, 1, 21, 0, 1), "resolved", "x"), ("b", 1, s, t, None, "open", "x"), ("c", None, s, t, None, "open", "x")],
        RAW_TICKETS,
    )
    assert {r["ticket_id"]: r["resolution_days"] for r in staging.stage_tickets(tickets).collect()} == {"a": 1, "b": 12}


def test_line_key_ignores_price_and_handles_nulls(spark):
    lines = core.order_lines(staging.stage_invoices(raw(spark, LINE, with_fields(UnitPrice=9.0), with_fields(StockCode=None))))
    keys = [r["order_line_id"] for r in lines.collect()]
    assert len(keys) == 3 and len(set(keys)) == 2 and None not in keys


def test_invoice_totals_and_customers(spark):
    rows = raw(
        spark,
        LINE,
        with_fields(StockCode="B", Quantity=1.0, InvoiceDate="2024-01-06 00:00:00", Country="US"),
        with_fields(InvoiceNo="C9", Quantity=-1.0, InvoiceDate="2024-03-01 00:00:00"),
    )
    totals = core.invoice_totals(core.order_lines(staging.stage_invoices(rows)))
    order = core.orders(totals).filter("invoice_no = '1'").first()
    assert (order["invoice_date"], order["country"], order["total_quantity"], order["total_revenue"], order["line_count"]) == (
        datetime(2024, 1, 5, 10), "US", 4, 10.0, 2,
    )
    customer = core.customers(totals).first()
    # cancelled invoices count here
    assert customer["lifetime_order_count"] == 2 and customer["last_order_date"] == datetime(2024, 3, 1)
    row = marts.customer_360(core.orders(totals), core.customers(totals)).first()
    # and not here
    assert row["lifetime_order_count"] == 1 and row["lifetime_revenue"] == 10.0


def test_customer_with_only_cancelled_orders(spark):
    totals = core.invoice_totals(core.order_lines(staging.stage_invoices(raw(spark, with_fields(InvoiceNo="C1")))))
    row = marts.customer_360(core.orders(totals), core.customers(totals)).first()
    assert row["lifetime_order_count"] is None and row["country"] == "UK"
    assert marts.rfm_measures(core.orders(totals)).count() == 0


def test_product_description_vote(spark):
    lines = spark.createDataFrame(
        [("A", "x")] * 2 + [("A", "y")] * 3 + [("B", "q"), ("B", "p"), ("B", None), (None, "z"), ("C", None)],
        "stock_code string, description string",
    )
    got = {r["product_id"]: r["description"] for r in core.products(lines).collect()}
    assert got == {"A": "y", "B": "p", "C": None}


@pytest.mark.parametrize(
    "r, f, name",
    [(5, 5, "champions"), (3, 4, "loyal"), (2, 4, "loyal"), (2, 3, "at_risk"), (1, 1, "hibernating"), (4, 2, "new"), (3, 3, "standard"), (5, 3, "standard")],
)
def test_segments(spark, r, f, name):
    df = spark.createDataFrame([(r, f)], "r_score int, f_score int")
    assert marts.with_segment(df).first()["segment"] == name


def test_rfm_of_few_customers(spark):
    orders = spark.createDataFrame(
        [(str(i), i, datetime(2024, 1, 1 + i), "X", False, 1, None if i == 3 else float(i), 1) for i in range(1, 8)],
        "invoice_no string, customer_id long, invoice_date timestamp_ntz, country string, is_cancelled boolean, total_quantity long, total_revenue double, line_count long",
    )
    rows = {r["customer_id"]: r for r in marts.rfm_segments(orders).collect()}
    assert rows[3]["m_score"] == 5  # NULL ranks as the largest value
    assert [rows[c]["f_score"] for c in range(1, 8)] == [1, 1, 2, 2, 3, 4, 5]
    assert rows[7]["r_score"] == 5 and rows[1]["r_score"] == 1
    assert rows[1]["avg_purchase_interval"] is None


def test_year_shift_clamps_leap_days(spark):
    df = spark.createDataFrame([(datetime(2012, 2, 29, 10),), (datetime(2011, 12, 9),)], "d timestamp_ntz")
    got = {r["d"] for r in shift_years(df, "d", 2013).collect()}
    assert got == {datetime(2013, 2, 28, 10), datetime(2012, 12, 9)}


def test_csv_load(spark, tmp_path):
    header = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
    (tmp_path / "a.csv").write_text(header + '1,A,"Mug, ""red""",2,2010-12-01 08:26:00,2.55,17850.0,UK\n')
    (tmp_path / "b.csv").write_text(header + "2,B,,1,2011-12-09 12:50:00,1,,UK\n")
    df = load_invoices(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}, 2024)
    rows = {r["InvoiceNo"]: r for r in df.collect()}
    assert rows["1"]["Description"] == 'Mug, "red"' and rows["1"]["InvoiceDate"] == "2023-12-01 08:26:00"
    assert rows["2"]["CustomerID"] is None and rows["2"]["source_sheet"] == "b"
    (tmp_path / "c.csv").write_text(header + "3,C,x,1,soon,1,1,UK\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_invoices(spark, {"c": str(tmp_path / "c.csv")}, 2024).collect()
