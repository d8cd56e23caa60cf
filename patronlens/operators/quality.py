"""Declarative data-quality checks.

Result rows: ``table_name, column_name, test, severity, failures, passed``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from patronlens.fixed_values import EVENT_TYPES, SEGMENTS, TICKET_STATUSES
from patronlens.functions.values import count_where

NOT_NULL, UNIQUE, ACCEPTED = "not_null", "unique", "accepted_values"


@dataclass(frozen=True)
class Check:
    table: str
    column: str
    test: str
    values: tuple = ()
    severity: str = "error"


def _checks(table: str, severity: str = "error", **columns) -> list[Check]:
    """Keyword per column: test names, or a tuple of accepted values, in a list."""
    out = []
    for column, tests in columns.items():
        for test in tests:
            if isinstance(test, tuple):
                out.append(Check(table, column, ACCEPTED, test, severity))
            else:
                out.append(Check(table, column, test, (), severity))
    return out


_KEY = [UNIQUE, NOT_NULL]
_SCORES = (1, 2, 3, 4, 5)

STANDARD_CHECKS: list[Check] = [
    *_checks("raw_invoices", "warn", CustomerID=[NOT_NULL]),
    *_checks("raw_events", "warn", customer_id=[NOT_NULL], event_type=[EVENT_TYPES]),
    *_checks("raw_support_tickets", "warn", customer_id=[NOT_NULL], status=[TICKET_STATUSES]),
    *_checks("stg_invoices", invoice_no=[NOT_NULL], customer_id=[NOT_NULL], is_cancelled=[(True, False)]),
    *_checks("stg_events", event_id=_KEY, customer_id=[NOT_NULL], event_type=[EVENT_TYPES]),
    *_checks(
        "stg_support_tickets",
        ticket_id=_KEY,
        customer_id=[NOT_NULL],
        status=[TICKET_STATUSES],
        resolution_days=[NOT_NULL],
    ),
    *_checks("fct_order_lines", order_line_id=_KEY, customer_id=[NOT_NULL]),
    *_checks("fct_orders", invoice_no=_KEY),
    *_checks("dim_customers", customer_id=_KEY),
    *_checks("customer_snapshot_dates", customer_id=[NOT_NULL]),
    *_checks("churn_feature_panel", churned_next_90d=[(0, 1), NOT_NULL]),
    *_checks("dim_products", product_id=_KEY),
    *_checks("mart_customer_360", customer_id=_KEY),
    *_checks(
        "mart_rfm_segments",
        customer_id=_KEY,
        r_score=[_SCORES],
        f_score=[_SCORES],
        m_score=[_SCORES],
        segment=[SEGMENTS],
    ),
    *_checks("churn_features", churned_next_90d=[NOT_NULL, (0, 1)]),
]


def _findings(check: Check, number: int) -> Column:
    """What a row adds to a check: a 128-bit hash of the value to count, or NULL."""
    value = F.col(check.column)
    if check.test == NOT_NULL:
        zero = F.lit(0).cast("long")
        return F.when(value.isNull(), F.struct(F.lit(number).alias("check"), zero.alias("h1"), zero.alias("h2")))
    text = value.cast("string")
    finding = F.struct(
        F.lit(number).alias("check"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("second")).alias("h2")
    )
    if check.test == UNIQUE:
        return F.when(value.isNotNull(), finding)
    return F.when(~value.isin(list(check.values)), finding)


def _table_report(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All checks of a table in one scan: findings are counted by check and value, then by check.

    A NULL check counts rows, a unique check values that occur more than once, an
    accepted-values check distinct foreign values; NULL passes the last two. Values are
    told apart by two 64-bit hashes, so keys of any length travel in 16 bytes.
    """
    pairs = df.select(F.inline(F.array_compact(F.array(*[_findings(c, i) for i, c in enumerate(checks)]))))
    counted = pairs.groupBy("check", "h1", "h2").agg(F.count(F.lit(1)).alias("times"))
    failures = {
        NOT_NULL: F.sum("times"),
        UNIQUE: F.sum(F.when(F.col("times") > 1, 1).otherwise(0)),
        ACCEPTED: F.count(F.lit(1)),
    }
    own = counted.groupBy("check").agg(*[f.cast("long").alias(t) for t, f in failures.items()])
    totals = own.agg(
        *[
            F.coalesce(F.max(F.when(F.col("check") == i, F.col(c.test))), F.lit(0)).alias(f"n{i}")
            for i, c in enumerate(checks)
        ]
    )
    rows = [
        F.struct(
            F.lit(c.table).alias("table_name"),
            F.lit(c.column).alias("column_name"),
            F.lit(c.test).alias("test"),
            F.lit(c.severity).alias("severity"),
            F.col(f"n{i}").alias("failures"),
            (F.col(f"n{i}") == 0).alias("passed"),
        )
        for i, c in enumerate(checks)
    ]
    return totals.select(F.inline(F.array(*rows)))


def quality_report(tables: dict[str, DataFrame], checks: list[Check] | None = None) -> DataFrame:
    """Run the checks: one scan and one two-level count for each table."""
    checks = STANDARD_CHECKS if checks is None else checks
    return reduce(
        DataFrame.unionByName,
        [
            _table_report(tables[name], [c for c in checks if c.table == name])
            for name in dict.fromkeys(c.table for c in checks)
        ],
    )


def require_passed(report: DataFrame) -> None:
    """Raise if a check of severity ``error`` failed; warnings only report."""
    failed = report.filter((F.col("severity") == "error") & ~F.col("passed")).collect()
    if failed:
        names = ", ".join(f"{r.table_name}.{r.column_name} {r.test} ({r.failures})" for r in failed)
        raise ValueError(f"data-quality checks failed: {names}")


def watched(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, Callable[[], dict[Check, int]]]:
    """``df`` that takes its not_null and accepted_values checks while it is written, without a scan of its own.

    The second value is called after the write: it returns the rows that failed each check
    and raises if one of severity ``error`` has any. Unique checks need a shuffle and stay
    with ``quality_report``.
    """
    own = [c for c in checks if c.test != UNIQUE]
    if not own:
        return df, dict
    taken = Observation()
    failed = [
        F.col(c.column).isNull() if c.test == NOT_NULL else F.col(c.column).isNotNull() & ~F.col(c.column).isin(list(c.values))
        for c in own
    ]

    def verify() -> dict[Check, int]:
        failures = {c: taken.get[f"n{i}"] for i, c in enumerate(own)}
        errors = [f"{c.table}.{c.column} {c.test} ({n})" for c, n in failures.items() if n and c.severity == "error"]
        if errors:
            raise ValueError(f"data-quality checks failed: {', '.join(errors)}")
        return failures

    return df.observe(taken, *[count_where(f).alias(f"n{i}") for i, f in enumerate(failed)]), verify
