"""Raw inputs derived from the test tables (rules in FIXTURES.md).

Real deployments read ``raw_invoices``, ``raw_events`` and ``raw_support_tickets``
from storage; these functions give the same schemas over the star-schema test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.functions.dates import days, midnight, month_ceil, month_starts, timestamp_text
from patronlens.fixed_values import RECENT_DAYS
from patronlens.sources.invoices import shift_years

TARGET_YEAR = 2024
TOPICS = ("shipping", "product_quality", "billing", "returns", "other")
PASSAGE_CHARS, LONG_PASSAGE_CHARS = 200, 400
ATTEMPTS, REQUEST_STEP = 3, 1_000_000_000


class TestTables:
    """Lazy scans of the parquet tables in one folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        scan = self.spark.read.parquet(self.path(name))
        setattr(self, name, scan)
        return scan


def shifted_orders(t: TestTables) -> DataFrame:
    orders = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return shift_years(orders.withColumn("original_year", F.year("o_orderdate")), "o_orderdate", TARGET_YEAR)


def raw_invoices(t: TestTables) -> DataFrame:
    order_key, customer_key = F.col("o_orderkey"), F.col("o_custkey")
    headers = (
        shifted_orders(t)
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            "o_custkey",
            F.when(order_key % 997 == 0, F.lit("not-a-date"))
            .otherwise(timestamp_text(F.col("o_orderdate")))
            .alias("InvoiceDate"),
            F.when(order_key % 50 != 7, customer_key.cast("double")).alias("CustomerID"),
            F.col("n_name").alias("Country"),
            F.when(F.col("original_year") <= 1998, "a").otherwise("b").alias("source_sheet"),
        )
    )
    cancelled = (F.col("l_returnflag") == "R") | (customer_key % 50 == 3)
    lines = (
        # the parts first, while lines are narrow: past the broadcast size that join moves every line
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        # two facts: their compressed size is no guide to a hash table's size
        .join(headers.hint("merge"), F.col("l_orderkey") == order_key)
        .select(
            F.concat(F.when(cancelled, "C").otherwise(""), order_key.cast("string")).alias("InvoiceNo"),
            F.when(customer_key % 50 != 11, F.col("l_partkey").cast("string")).alias("StockCode"),
            F.when(F.col("l_linenumber") > 4, F.upper("p_name")).otherwise(F.col("p_name")).alias("Description"),
            (F.when(cancelled, -1.0).otherwise(1.0) * F.col("l_quantity")).alias("Quantity"),
            "InvoiceDate",
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).alias("UnitPrice"),
            "CustomerID",
            "Country",
            "source_sheet",
            # the first line of an invoice occurs twice, so that DISTINCT has work to do
            F.explode(F.when(F.col("l_linenumber") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
    )
    return lines.drop("copy")


def _snapshots_of(ts: Column) -> Column:
    """Month starts s with s - 90 days < ts <= s."""
    last = midnight(ts + days(RECENT_DAYS))
    exclusive = F.when(last == ts + days(RECENT_DAYS), last - days(1)).otherwise(last)
    return month_starts(month_ceil(ts), F.trunc(exclusive, "month").cast("timestamp_ntz"))


def _snapshot_rows(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    return events.withColumn("ts", ts).withColumn("snapshot_date", F.explode(_snapshots_of(F.col("ts"))))


def _row_id() -> Column:
    return F.concat_ws("@", F.col("event_id"), F.date_format("snapshot_date", "yyyy-MM-dd"))


def raw_events(t: TestTables) -> DataFrame:
    kind = F.col("event_type")
    return _snapshot_rows(t.events.filter(kind != "error")).select(
        _row_id().alias("event_id"),
        F.col("user_id").alias("customer_id"),
        "snapshot_date",
        F.col("ts").alias("event_timestamp"),
        F.when(kind == "view", "page_view")
        .when(kind == "click", "product_view")
        .when(kind == "purchase", "add_to_cart")
        .when(kind == "signup", "login")
        .otherwise(kind)
        .alias("event_type"),
    )


def raw_support_tickets(t: TestTables) -> DataFrame:
    tickets = _snapshot_rows(t.events.filter(F.col("event_type") == "error"))
    closed = F.col("ts") + F.make_dt_interval(F.floor(F.col("value") / 10).cast("int"))
    is_closed = closed < F.col("snapshot_date")
    topics = F.array(*[F.lit(x) for x in TOPICS])
    return tickets.select(
        _row_id().alias("ticket_id"),
        F.col("user_id").alias("customer_id"),
        "snapshot_date",
        F.col("ts").alias("created_at"),
        F.when(is_closed, closed).alias("resolved_at"),
        F.when(is_closed, "resolved").otherwise("open").alias("status"),
        F.element_at(topics, (F.col("event_id") % 5 + 1).cast("int")).alias("topic"),
    )


def proposals(t: TestTables) -> DataFrame:
    """Offer proposals cut from the documents: every passage of every text is one attempt.

    Three passages in a row are the attempts of one request; the requests of a document
    after its first have customer ids of their own. A third of the documents is cut into
    passages that are too long for an offer. Some payloads are no JSON, lack fields or
    hold one of the wrong type.
    """
    passages = F.when(F.col("doc_id") % 3 == 0, _passages(LONG_PASSAGE_CHARS)).otherwise(_passages(PASSAGE_CHARS))
    rows = t.documents.select("doc_id", F.posexplode(passages).alias("n", "passage"))
    mix = F.col("doc_id") + F.col("n")
    discounts = F.array(*[F.lit(d) for d in (0, 10, 15, 20, 5)])
    customer = F.col("doc_id") + F.floor(F.col("n") / ATTEMPTS) * REQUEST_STEP
    terms = [
        F.element_at(discounts, (mix % 5 + 1).cast("int")).alias("discount_pct"),
        F.when(mix % 7 == 6, "sms").when(mix % 2 == 0, "email").otherwise("push").alias("channel"),
    ]
    texts = [
        F.when(mix % 11 == 0, "none-such").otherwise(F.concat((mix % 200).cast("string"), F.lit(": x"))).alias("product_focus"),
        F.concat("passage", F.when(mix % 13 == 0, " call 555-123-4567").otherwise("")).alias("messaging"),
    ]
    payload = (
        F.when(mix % 17 == 3, "no offer today")
        .when(mix % 17 == 5, F.to_json(F.struct(*terms)))
        .when(mix % 17 == 7, F.to_json(F.struct(F.lit("unknown").alias("customer_id"), *terms, *texts)))
        .otherwise(F.to_json(F.struct(customer.alias("customer_id"), *terms, *texts)))
    )
    return rows.select(
        customer.alias("customer_id"), (F.col("n") % ATTEMPTS + 1).alias("attempt"), payload.alias("payload")
    )


def _passages(width: int) -> Column:
    return F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def fixed_score(rows: DataFrame) -> DataFrame:
    """``rows`` plus a ``churn_probability`` that SQL can state too.

    It stands in for the model where a result is compared with SQL. Only exact
    operations are used, so every engine gets the same bits.
    """
    customer_term = (F.col("customer_id") * 37 % 1009) / 1009
    raw = 1 / (1 + F.col("frequency_180d") + F.coalesce(F.col("monetary_180d"), F.lit(0.0)) / 100000 + customer_term)
    return rows.withColumn("churn_probability", F.floor(raw * 1000000 + 0.5) / 1000000)


def fixed_impacts() -> list[tuple[str, Column]]:
    """The terms of the fixed score, in the role of feature impacts."""
    return [
        ("frequency_180d", -F.col("frequency_180d").cast("double")),
        ("monetary_180d", -F.coalesce(F.col("monetary_180d"), F.lit(0.0)) / 100000),
        ("order_trend_90d", F.coalesce(F.col("order_trend_90d"), F.lit(0.0))),
        ("customer_term", -(F.col("customer_id") * 37 % 1009) / 1009),
    ]
