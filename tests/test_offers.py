from __future__ import annotations

import json
from datetime import datetime

import pytest

from patronlens.operators import offers
from patronlens.plans.retention import outcome_counts, retention_run, retry_rounds
from patronlens.schemas import PROPOSALS

GOOD = {"customer_id": 1, "discount_pct": 10, "channel": "email", "product_focus": "22139", "messaging": "Come back!"}


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([("22139", "TEA SET"), ("85048", "LAMP")], "product_id string, description string")


def check(spark, products, *payloads):
    rows = [(i, 1, p if isinstance(p, (str, type(None))) else json.dumps(p)) for i, p in enumerate(payloads)]
    checked = offers.check_offers(spark.createDataFrame(rows, PROPOSALS), products)
    return [r for r in checked.orderBy("customer_id").collect()]


CASES = [
    ({}, []),
    ({"messaging": "hello there"}, ["profanity"]),
    ({"messaging": "Sea SHELLS"}, ["profanity"]),
    ({"messaging": "mail a.b@c.org now"}, ["pii_email"]),
    ({"messaging": "call 555-123-4567"}, ["pii_phone"]),
    ({"messaging": "card 4111 1111 1111 1111"}, ["pii_card"]),
    ({"messaging": "x" * 300}, []),
    ({"messaging": "x" * 301}, ["messaging_length"]),
    ({"messaging": None}, ["messaging_missing"]),
    ({"messaging": 5}, ["messaging_missing"]),
    ({"discount_pct": 5}, ["discount_pct"]),
    ({"discount_pct": "10"}, []),
    ({"discount_pct": 10.0}, []),
    ({"discount_pct": "5.5"}, ["discount_pct"]),
    ({"discount_pct": 0}, []),
    ({"customer_id": "12"}, []),
    ({"customer_id": "x"}, ["customer_id"]),
    ({"channel": "EMAIL"}, ["channel"]),
    ({"channel": "push"}, []),
    ({"product_focus": "22139: TEA SET"}, []),
    ({"product_focus": " 22139 (TEA SET): x"}, []),
    ({"product_focus": 22139}, ["product_focus"]),
    ({"product_focus": "99"}, ["unknown_product"]),
    ({"extra": True}, []),
    ({"channel": "sms", "discount_pct": 7}, ["discount_pct", "channel"]),
]


def test_rules(spark, products):
    got = check(spark, products, *[{**GOOD, **change} for change, _ in CASES])
    for row, (change, reasons) in zip(got, CASES):
        assert row["reasons"] == reasons, change


def test_malformed_json(spark, products):
    for row in check(spark, products, "{oops", "[1, 2]", '"text"', None):
        assert row["reasons"] == ["malformed_json"]
    missing = check(spark, products, "{}")[0]["reasons"]
    assert missing == ["customer_id", "discount_pct", "channel", "product_focus", "messaging_missing"]


def test_unicode_digits_count_as_phone(spark, products):
    assert check(spark, products, {**GOOD, "messaging": "٥٥٥-١٢٣-٤٥٦٧"})[0]["reasons"] == ["pii_phone"]


def proposals(spark, attempts):
    """attempts: {customer: number of the first good attempt}"""
    rows = []
    for customer, good in attempts.items():
        for attempt in range(1, 5):
            change = {} if attempt >= good else {"channel": "fax"}
            rows.append((customer, attempt, json.dumps({**GOOD, "customer_id": customer, **change, "messaging": f"try {attempt}"})))
    return spark.createDataFrame(rows, PROPOSALS)


def test_first_valid_of_three(spark, products):
    checked = offers.check_offers(proposals(spark, {1: 1, 2: 2, 3: 3, 4: 4, 5: 9}), products)
    got = {r["customer_id"]: r["messaging"] for r in offers.first_valid(offers.accepted(checked)).collect()}
    assert got == {1: "try 1", 2: "try 2", 3: "try 3"}
    assert offers.accepted(checked).count() + offers.rejected(checked).count() == checked.count() == 20


def test_retention_run(spark, products):
    predictions = spark.createDataFrame(
        [(c, datetime(2024, 5, 1), 1 - c / 10, "low" if c == 6 else "high") for c in range(1, 7)],
        "customer_id long, snapshot_date timestamp_ntz, churn_probability double, risk_band string",
    )
    profiles = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 6)], "customer_id long")
    asked = proposals(spark, {1: 1, 2: 4, 3: 3, 5: 1, 6: 1})
    run = retention_run(predictions, profiles, asked, products)
    assert {r["customer_id"]: r["status"] for r in run.outcomes.collect()} == {
        1: "succeeded", 2: "no_valid_offer", 3: "succeeded", 4: "no_valid_offer", 5: "no_profile",
    }
    assert {r["customer_id"] for r in run.interventions.collect()} == {1, 3}
    assert {r["result"]: r["n_customers"] for r in outcome_counts(run.outcomes).collect()} == {"succeeded": 2, "failed": 3}
    limited = retention_run(predictions, profiles, asked, products, limit=2)
    assert {r["customer_id"] for r in limited.outcomes.collect()} == {1, 2}
    assert retention_run(predictions, profiles, asked, products, limit=0).outcomes.count() == 5


def test_candidates_and_fallback(spark):
    stock = spark.createDataFrame([(f"p{i:02d}", f"d{i}") for i in range(20)], "product_id string, description string")
    lines = spark.createDataFrame(
        [(1, f"p{i:02d}", datetime(2024, 1, 1 + i)) for i in range(20)]
        + [(1, "p00", datetime(2024, 3, 1)), (2, "gone", datetime(2024, 1, 1)), (3, None, datetime(2024, 1, 1))],
        "customer_id long, stock_code string, invoice_date timestamp_ntz",
    )
    bought = offers.purchased_products(lines, stock)
    top = [r["product_id"] for r in offers.candidate_products(bought).orderBy("position").collect()]
    assert top == ["p00"] + [f"p{i:02d}" for i in range(19, 5, -1)]
    fallback = offers.fallback_products(lines.select("customer_id").distinct(), bought, stock)
    got = {}
    for r in fallback.orderBy("customer_id", "position").collect():
        got.setdefault(r["customer_id"], []).append(r["product_id"])
    assert got == {c: [f"p{i:02d}" for i in range(15)] for c in (2, 3)}


def test_feedback_of_a_failed_attempt(spark, products):
    stamp = datetime(2024, 1, 1)
    profile = spark.createDataFrame(
        [(1, "UK", stamp, stamp, 2, 10.5, 3, 2, 10.5, None, "new", 7)],
        "customer_id long, country string, first_order_date timestamp_ntz, last_order_date timestamp_ntz, lifetime_order_count long, "
        "lifetime_revenue double, recency_days int, frequency_lifetime long, monetary_lifetime double, avg_purchase_interval double, segment string, rfm_score int",
    )
    explanation = spark.createDataFrame(
        [(1, stamp, 0.5, [("events_30d", -0.25)])],
        "customer_id long, snapshot_date timestamp_ntz, churn_probability double, top_features array<struct<name:string,impact:double>>",
    )
    candidates = spark.createDataFrame([(1, "b", None, 2), (1, "a", "A", 1)], "customer_id long, product_id string, description string, position int")
    failed = spark.createDataFrame([(1, ["channel", "profanity"])], "customer_id long, reasons array<string>")
    row = offers.offer_context(profile, explanation, candidates, failed).first()
    assert row["products_block"] == "- a (description: A)\n- b (description: None)"
    assert row["feedback"] == "channel, profanity"
    assert json.loads(row["profile_json"])["avg_purchase_interval"] is None
    assert json.loads(row["explanation_json"])["top_features"] == [{"name": "events_30d", "impact": -0.25}]


def test_retry_rounds_pass_failures_on(spark, products):
    contexts = spark.createDataFrame([(c, f"profile {c}") for c in range(1, 6)], "customer_id long, profile_json string")
    seen = []

    def answer(requests, attempt):
        seen.append({r["customer_id"]: r["feedback"] for r in requests.collect()})
        rows = []
        for c in seen[-1]:
            good = {1: 1, 2: 2, 3: 3, 4: 9}.get(c)
            if good is None:  # customer 5 is never answered
                continue
            change = {} if attempt >= good else {"channel": "fax", "discount_pct": attempt}
            rows.append((c, json.dumps({**GOOD, "customer_id": c, **change})))
            if c == 2 and attempt == 2:
                rows.append((c, "{oops"))  # one valid answer is enough
        return spark.createDataFrame(rows, "customer_id long, payload string")

    rounds = retry_rounds(contexts, answer, products)
    failed = "discount_pct, channel"
    assert seen == [
        dict.fromkeys(range(1, 6)),
        {2: failed, 3: failed, 4: failed, 5: "no_answer"},
        {3: failed, 4: failed, 5: "no_answer"},
    ]
    assert {(r["customer_id"], r["attempt"]) for r in rounds.requests.collect()} == {
        (c, n + 1) for n, open_now in enumerate(seen) for c in open_now}
    assert {(r["customer_id"], r["attempt"]) for r in rounds.state.filter("accepted").collect()} == {(1, 1), (2, 2), (3, 3)}
    assert rounds.state.filter("attempt = 3 AND NOT accepted").select("customer_id", "feedback").count() == 2
    assert set(rounds.requests.columns) == {"customer_id", "profile_json", "feedback", "attempt"}
    assert retry_rounds(contexts.limit(0), answer, products).state.count() == 0
