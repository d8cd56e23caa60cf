"""Declared schemas of the raw inputs and of the published tables with a fixed layout."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
_NTZ = T.TimestampNTZType()

# Columns of one invoice CSV file; the sheet is added by the reader.
INVOICE_CSV = _struct(
    ("InvoiceNo", _TEXT),
    ("StockCode", _TEXT),
    ("Description", _TEXT),
    ("Quantity", _DOUBLE),
    ("InvoiceDate", _TEXT),
    ("UnitPrice", _DOUBLE),
    ("CustomerID", _DOUBLE),
    ("Country", _TEXT),
)

RAW_INVOICES = T.StructType(INVOICE_CSV.fields + [T.StructField("source_sheet", _TEXT, True)])

RAW_EVENTS = _struct(
    ("event_id", _TEXT),
    ("customer_id", _LONG),
    ("snapshot_date", _NTZ),
    ("event_timestamp", _NTZ),
    ("event_type", _TEXT),
)

RAW_TICKETS = _struct(
    ("ticket_id", _TEXT),
    ("customer_id", _LONG),
    ("snapshot_date", _NTZ),
    ("created_at", _NTZ),
    ("resolved_at", _NTZ),
    ("status", _TEXT),
    ("topic", _TEXT),
)

PREDICTIONS = _struct(
    ("customer_id", _LONG),
    ("snapshot_date", T.DateType()),
    ("churn_probability", _DOUBLE),
    ("risk_band", _TEXT),
    ("scored_at", _NTZ),
)

INTERVENTIONS = _struct(
    ("customer_id", _LONG),
    ("discount_pct", T.IntegerType()),
    ("channel", _TEXT),
    ("product_focus", _TEXT),
    ("messaging", _TEXT),
    ("generated_at", _NTZ),
)

PROPOSALS = _struct(("customer_id", _LONG), ("attempt", T.IntegerType()), ("payload", _TEXT))

TOP_FEATURES = T.ArrayType(_struct(("name", _TEXT), ("impact", _DOUBLE)))
