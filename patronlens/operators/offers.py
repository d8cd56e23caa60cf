"""Retention offers: candidate products, request context, validation and retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.functions.values import stripped
from patronlens.fixed_values import (
    BLOCKED_WORDS,
    CANDIDATE_PRODUCTS,
    CHANNELS,
    DISCOUNT_TIERS,
    MAX_ATTEMPTS,
    MAX_MESSAGE_CHARS,
    PII_PATTERNS,
)

# --- candidate products ----------------------------------------------------------------------


def purchased_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Products each customer bought, with the latest purchase.

    Repeat purchases are merged before the join with the products.
    """
    bought = (
        lines.filter(F.col("stock_code").isNotNull())
        .groupBy("customer_id", "stock_code")
        .agg(F.max("invoice_date").alias("last_purchased_at"))
    )
    return bought.join(products, F.col("stock_code") == F.col("product_id")).select(
        "customer_id", "product_id", "description", "last_purchased_at"
    )


def candidate_products(purchased: DataFrame, limit: int = CANDIDATE_PRODUCTS) -> DataFrame:
    """The most recently bought products of each customer.

    The rank filter lets Spark keep ``limit`` rows per customer in each task before
    the shuffle.
    """
    newest = Window.partitionBy("customer_id").orderBy(
        F.col("last_purchased_at").desc_nulls_first(), F.col("product_id")
    )
    return (
        purchased.withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= limit)
        .select("customer_id", "product_id", "description", "position")
    )


def fallback_products(
    customers: DataFrame, purchased: DataFrame, products: DataFrame, limit: int = CANDIDATE_PRODUCTS
) -> DataFrame:
    """The first ``limit`` products for every customer without a known purchase."""
    first = (
        products.orderBy("product_id")
        .limit(limit)
        .agg(F.sort_array(F.collect_list(F.struct("product_id", "description"))).alias("items"))
        .scalar()
    )
    buyers = purchased.select("customer_id").distinct()
    without = customers.select("customer_id").join(buyers, "customer_id", "left_anti")
    return without.select("customer_id", F.posexplode(first).alias("n", "item")).select(
        "customer_id", "item.product_id", "item.description", (F.col("n") + 1).alias("position")
    )


# --- request context -------------------------------------------------------------------------

PROFILE_JSON_COLUMNS = (
    "customer_id",
    "country",
    "first_order_date",
    "last_order_date",
    "lifetime_order_count",
    "lifetime_revenue",
    "recency_days",
    "frequency_lifetime",
    "monetary_lifetime",
    "avg_purchase_interval",
    "segment",
    "rfm_score",
)


def _json_value(df: DataFrame, column: str) -> Column:
    """Plain text forms: ISO timestamps and decimals without exponents."""
    kind = dict(df.dtypes)[column]
    if kind == "double":
        return F.col(column).cast("decimal(20,6)").alias(column)
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)
    return F.col(column)


def profile_json(profiles: DataFrame) -> DataFrame:
    """One JSON text per profile.

    Spark reckons with 20 bytes for a text; these are 20 times longer, so their joins are
    told not to send them to every task.
    """
    fields = [_json_value(profiles, c) for c in PROFILE_JSON_COLUMNS]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return profiles.select("customer_id", text.alias("profile_json")).hint("merge")


def explanation_json(explanations: DataFrame) -> DataFrame:
    """One JSON text per explanation; impacts and probability as decimals of four places. Joins merge, as above."""
    impacts = F.transform(
        "top_features",
        lambda f: F.struct(f["name"].alias("name"), f["impact"].cast("decimal(20,4)").alias("impact")),
    )
    text = F.to_json(
        F.struct(
            "customer_id",
            F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"),
            F.col("churn_probability").cast("decimal(20,4)").alias("churn_probability"),
            impacts.alias("top_features"),
        )
    )
    return explanations.select("customer_id", text.alias("explanation_json")).hint("merge")


def offer_context(
    profiles: DataFrame,
    explanations: DataFrame,
    candidates: DataFrame,
    previous_failures: DataFrame | None = None,
) -> DataFrame:
    """One row per customer with everything an external offer generator is given.

    ``previous_failures`` (customer_id, reasons) of a rejected attempt becomes feedback.
    """
    listed = F.array_sort(F.collect_list(F.struct("position", "product_id", "description")))

    def line(product: Column) -> Column:
        name, description = F.coalesce(product["product_id"], F.lit("null")), F.coalesce(product["description"], F.lit("None"))
        return F.concat(F.lit("- "), name, F.lit(" (description: "), description, F.lit(")"))

    lines = F.transform(listed, line)
    products = candidates.groupBy("customer_id").agg(F.concat_ws("\n", lines).alias("products_block"))
    context = (
        profile_json(profiles)
        .join(explanation_json(explanations), "customer_id")
        .join(products, "customer_id")
    )
    if previous_failures is None:
        return context.withColumn("feedback", F.lit(None).cast("string"))
    feedback = previous_failures.select("customer_id", F.concat_ws(", ", "reasons").alias("feedback"))
    return context.join(feedback, "customer_id", "left")


# --- validation ------------------------------------------------------------------------------

_WHOLE_NUMBER = r"^[+-]?\d+(\.0+)?$"


def _text_field(name: str) -> Column:
    """The field if it is a JSON string, else NULL."""
    value = F.try_variant_get("record", f"$.{name}", "variant")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.try_variant_get("record", f"$.{name}", "string"))


def _whole_field(name: str, kind: str) -> Column:
    """The field if it is a whole number or the text of one, else NULL."""
    text = stripped(F.try_variant_get("record", f"$.{name}", "string"))
    return F.when(text.rlike(_WHOLE_NUMBER), F.regexp_replace(text, r"\.0+$", "").try_cast(kind))


def bare_product_id(text: Column) -> Column:
    """The part before the first colon or parenthesis, trimmed."""
    return stripped(F.element_at(F.split(stripped(text), "[:(]", 2), 1))


def parse_proposals(proposals: DataFrame) -> DataFrame:
    """Typed fields of each JSON proposal; a wrongly typed field is NULL."""
    record = F.try_parse_json("payload")
    return (
        proposals.withColumn("record", record)
        .withColumn("is_object", F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)))
        .select(
            "customer_id",
            "attempt",
            "is_object",
            _whole_field("customer_id", "long").alias("offer_customer_id"),
            _whole_field("discount_pct", "int").alias("discount_pct"),
            _text_field("channel").alias("channel"),
            bare_product_id(_text_field("product_focus")).alias("product_focus"),
            _text_field("messaging").alias("messaging"),
        )
    )


def message_problems(message: Column) -> list[Column]:
    """Reason codes of a message, NULL where the rule is met."""
    lowered = F.lower(message)
    blocked = reduce(lambda a, b: a | b, [lowered.contains(w) for w in BLOCKED_WORDS])
    problems = [
        F.when(message.isNull(), "messaging_missing"),
        F.when(F.length(message) > MAX_MESSAGE_CHARS, "messaging_length"),
        F.when(blocked, "profanity"),
    ]
    # (?U): word and digit classes cover all scripts; most messages hold no digit at all
    # and skip the two digit patterns
    has_digit = message.rlike(r"(?U)\d")
    possible = {"email": message.contains("@"), "phone": has_digit, "card": has_digit}
    problems += [
        F.when(possible[name] & message.rlike("(?U)" + pattern), f"pii_{name}")
        for name, pattern in PII_PATTERNS.items()
    ]
    return problems


def check_offers(proposals: DataFrame, products: DataFrame) -> DataFrame:
    """Every proposal with the array of rules it breaks; empty means accepted.

    Payloads are parsed once, and products join with their ids only. Spark sends the ids to
    every task where they are small; else its join splits the rows of a product that many
    proposals name, and of those that name none. Messages are checked before that join, once,
    so it need not move their texts where only the reasons are wanted.
    """
    known = products.select(F.col("product_id").alias("product_focus"), F.lit(True).alias("known"))
    message = F.array_compact(F.array(*message_problems(F.col("messaging")))).alias("message_problems")
    parsed = parse_proposals(proposals).select("*", message).join(known, "product_focus", "left")
    ok_object = F.col("is_object")
    field_rules = [
        F.when(F.col("offer_customer_id").isNull(), "customer_id"),
        F.when(~F.coalesce(F.col("discount_pct").isin(*DISCOUNT_TIERS), F.lit(False)), "discount_pct"),
        F.when(~F.coalesce(F.col("channel").isin(*CHANNELS), F.lit(False)), "channel"),
        F.when(F.col("product_focus").isNull(), "product_focus"),
        F.when(F.col("product_focus").isNotNull() & F.col("known").isNull(), "unknown_product"),
    ]
    broken = F.concat(F.array_compact(F.array(*field_rules)), F.col("message_problems"))
    reasons = F.when(ok_object, broken).otherwise(F.array(F.lit("malformed_json")))
    return parsed.select(
        "customer_id",
        "attempt",
        "offer_customer_id",
        "discount_pct",
        "channel",
        "product_focus",
        "messaging",
        reasons.alias("reasons"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def first_valid(accepted_offers: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The earliest accepted attempt of each customer within the retry limit.

    The attempt is found by a hash aggregate over numbers; only its rows' texts are
    fetched. Should an attempt occur twice, the least row in column order counts.
    """
    rest = [c for c in accepted_offers.columns if c not in ("customer_id", "attempt")]
    within = accepted_offers.filter(F.col("attempt") <= max_attempts)
    first = within.groupBy("customer_id").agg(F.min("attempt").alias("attempt"))
    return (
        within.join(first, ["customer_id", "attempt"], "left_semi")
        .groupBy("customer_id", "attempt")
        .agg(F.min(F.struct(*rest)).alias("first"))
        .select("customer_id", "attempt", "first.*")
    )


def valid_product_focus(checked: DataFrame, products: DataFrame) -> DataFrame:
    """Proposals whose product exists."""
    return checked.join(products, F.col("product_focus") == F.col("product_id"), "left_semi")
