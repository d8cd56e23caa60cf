"""DuckDB SQL for the registered queries, over the same parquet tables.

Every query is a chain of named steps; ``sql(final, *steps)`` puts the needed steps in
front of the final SELECT.
"""

from __future__ import annotations

STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, needs: tuple[str, ...], body: str) -> None:
    STEPS[name] = (needs, body)


def sql(final: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in STEPS[name][0]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n][1]})" for n in ordered) + "\n" + final


def table(name: str) -> str:
    return sql(f"SELECT * FROM {name}", name)


# --- raw inputs ------------------------------------------------------------------------------

step("year_shift", (), "SELECT CAST(2024 - max(year(o_orderdate)) AS INTEGER) AS k FROM orders")
step(
    "shifted_orders",
    ("year_shift",),
    """SELECT o_orderkey, o_custkey, year(o_orderdate) AS original_year,
              o_orderdate + to_years(k) AS o_orderdate
       FROM orders, year_shift""",
)
step(
    "raw_lines",
    ("shifted_orders",),
    """SELECT (CASE WHEN cancelled THEN 'C' ELSE '' END) || o_orderkey AS InvoiceNo,
              CASE WHEN o_custkey % 50 <> 11 THEN CAST(l_partkey AS VARCHAR) END AS StockCode,
              CASE WHEN l_linenumber > 4 THEN upper(p_name) ELSE p_name END AS Description,
              CASE WHEN cancelled THEN -l_quantity ELSE l_quantity END AS Quantity,
              CASE WHEN o_orderkey % 997 = 0 THEN 'not-a-date'
                   ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS InvoiceDate,
              floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS UnitPrice,
              CASE WHEN o_orderkey % 50 <> 7 THEN CAST(o_custkey AS DOUBLE) END AS CustomerID,
              n_name AS Country,
              CASE WHEN original_year <= 1998 THEN 'a' ELSE 'b' END AS source_sheet,
              l_linenumber
       FROM (SELECT *, l_returnflag = 'R' OR o_custkey % 50 = 3 AS cancelled
             FROM lineitem JOIN shifted_orders ON l_orderkey = o_orderkey)
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey""",
)
step(
    "raw_invoices",
    ("raw_lines",),
    """SELECT * EXCLUDE (l_linenumber) FROM raw_lines
       UNION ALL SELECT * EXCLUDE (l_linenumber) FROM raw_lines WHERE l_linenumber = 1""",
)
step("month_list", (), "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2025-12-01', INTERVAL 1 MONTH)) AS s")
step(
    "snapshot_events",
    ("month_list",),
    """SELECT event_id, ts, user_id, event_type, value, s
       FROM events JOIN month_list ON ts <= s AND ts > s - INTERVAL 90 DAY""",
)
step(
    "raw_events",
    ("snapshot_events",),
    """SELECT event_id || '@' || strftime(s, '%Y-%m-%d') AS event_id, user_id AS customer_id,
              s AS snapshot_date, ts AS event_timestamp,
              CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'product_view'
                   WHEN 'purchase' THEN 'add_to_cart' WHEN 'signup' THEN 'login'
                   ELSE event_type END AS event_type
       FROM snapshot_events WHERE event_type <> 'error'""",
)
step(
    "raw_support_tickets",
    ("snapshot_events",),
    """SELECT event_id || '@' || strftime(s, '%Y-%m-%d') AS ticket_id, user_id AS customer_id,
              s AS snapshot_date, ts AS created_at,
              CASE WHEN closed < s THEN closed END AS resolved_at,
              CASE WHEN closed < s THEN 'resolved' ELSE 'open' END AS status,
              ['shipping', 'product_quality', 'billing', 'returns', 'other'][event_id % 5 + 1] AS topic
       FROM (SELECT *, ts + to_days(CAST(floor(value / 10) AS INTEGER)) AS closed
             FROM snapshot_events WHERE event_type = 'error')""",
)

# --- staging and core ------------------------------------------------------------------------

step(
    "stg_invoices",
    ("raw_invoices",),
    """SELECT DISTINCT InvoiceNo AS invoice_no, StockCode AS stock_code, Description AS description,
              CAST(round(Quantity) AS BIGINT) AS quantity,
              TRY_CAST(InvoiceDate AS TIMESTAMP) AS invoice_date, UnitPrice AS unit_price,
              CAST(round(CustomerID) AS BIGINT) AS customer_id, Country AS country, source_sheet,
              coalesce(starts_with(InvoiceNo, 'C'), false) AS is_cancelled
       FROM raw_invoices WHERE CustomerID IS NOT NULL""",
)
step("stg_events", ("raw_events",), "SELECT * FROM raw_events WHERE customer_id IS NOT NULL")
step(
    "stg_support_tickets",
    ("raw_support_tickets",),
    """SELECT *, CAST(datediff('day', created_at, coalesce(resolved_at, snapshot_date)) AS INTEGER) AS resolution_days
       FROM raw_support_tickets WHERE customer_id IS NOT NULL""",
)
step(
    "fct_order_lines",
    ("stg_invoices",),
    """SELECT md5(concat_ws('-', coalesce(invoice_no, '_dbt_utils_surrogate_key_null_'),
                            coalesce(stock_code, '_dbt_utils_surrogate_key_null_'),
                            coalesce(strftime(invoice_date, '%Y-%m-%d %H:%M:%S'), '_dbt_utils_surrogate_key_null_'),
                            coalesce(CAST(customer_id AS VARCHAR), '_dbt_utils_surrogate_key_null_'))) AS order_line_id,
              * EXCLUDE (source_sheet), quantity * unit_price AS line_revenue
       FROM stg_invoices""",
)
step(
    "fct_orders",
    ("fct_order_lines",),
    """SELECT invoice_no, customer_id, min(invoice_date) AS invoice_date, max(country) AS country,
              bool_or(is_cancelled) AS is_cancelled, CAST(sum(quantity) AS BIGINT) AS total_quantity,
              CAST(sum(CAST(line_revenue AS DECIMAL(20, 6))) AS DOUBLE) AS total_revenue,
              count(*) AS line_count
       FROM fct_order_lines GROUP BY ALL""",
)
step(
    "dim_customers",
    ("fct_order_lines",),
    """SELECT customer_id, max(country) AS country, min(invoice_date) AS first_order_date,
              max(invoice_date) AS last_order_date, count(DISTINCT invoice_no) AS lifetime_order_count
       FROM fct_order_lines GROUP BY customer_id""",
)
step(
    "dim_products",
    ("fct_order_lines",),
    """SELECT stock_code AS product_id, description
       FROM (SELECT stock_code, description, count(*) AS n FROM fct_order_lines
             WHERE stock_code IS NOT NULL GROUP BY ALL)
       QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, description NULLS LAST) = 1""",
)
step(
    "completed_orders",
    ("fct_orders",),
    "SELECT customer_id, invoice_no, invoice_date, total_revenue FROM fct_orders WHERE NOT is_cancelled",
)

# --- panel -----------------------------------------------------------------------------------

step(
    "snapshot_bounds",
    ("completed_orders",),
    """SELECT min(invoice_date) + INTERVAL 90 DAY AS range_start,
              max(invoice_date) - INTERVAL 90 DAY AS range_end FROM completed_orders""",
)


def _spine(suffix: str, cap: int) -> None:
    step(
        f"snapshot_dates_{suffix}",
        ("snapshot_bounds", "dim_customers"),
        f"""SELECT customer_id, s AS snapshot_date
            FROM (SELECT date_trunc('month', range_start) + to_months(CAST(i AS INTEGER)) AS s, range_start, range_end
                  FROM snapshot_bounds, range({cap}) AS grid(i)) AS months
            JOIN dim_customers ON s >= first_order_date
            WHERE s BETWEEN range_start AND range_end""",
    )


_spine("60", 60)
_spine("120", 120)

step(
    "panel_order_features",
    ("snapshot_dates_120", "fct_orders"),
    """SELECT p.customer_id, p.snapshot_date,
              CAST(datediff('day', max(invoice_date) FILTER (WHERE past AND ok), p.snapshot_date) AS INTEGER)
                  AS days_since_last_order,
              count(*) FILTER (WHERE past AND in180 AND ok) AS frequency_180d,
              CAST(sum(CAST(total_revenue AS DECIMAL(20, 6))) FILTER (WHERE past AND in180 AND ok) AS DOUBLE)
                  AS monetary_180d,
              count(*) FILTER (WHERE past AND in90 AND ok) AS orders_recent_90d,
              count(*) FILTER (WHERE past AND in180 AND NOT in90 AND ok) AS orders_prior_90d,
              count(*) FILTER (WHERE past AND in90) AS total_invoices_90d,
              count(*) FILTER (WHERE past AND in90 AND NOT ok) AS cancelled_invoices_90d,
              CAST(count(*) FILTER (WHERE NOT past AND ok) > 0 AS INTEGER) AS has_future_order
       FROM snapshot_dates_120 p
       LEFT JOIN (SELECT s.customer_id, s.snapshot_date, o.invoice_date, o.total_revenue,
                         NOT o.is_cancelled AS ok, o.invoice_date <= s.snapshot_date AS past,
                         o.invoice_date > s.snapshot_date - INTERVAL 90 DAY AS in90,
                         o.invoice_date > s.snapshot_date - INTERVAL 180 DAY AS in180
                  FROM snapshot_dates_120 s JOIN fct_orders o ON o.customer_id = s.customer_id
                   AND o.invoice_date BETWEEN s.snapshot_date - INTERVAL 180 DAY
                                          AND s.snapshot_date + INTERVAL 90 DAY) w
         ON w.customer_id = p.customer_id AND w.snapshot_date = p.snapshot_date
       GROUP BY p.customer_id, p.snapshot_date""",
)
step(
    "panel_event_features",
    ("snapshot_dates_120", "stg_events"),
    """SELECT s.customer_id, s.snapshot_date,
              count(event_timestamp) FILTER (WHERE event_timestamp > s.snapshot_date - INTERVAL 30 DAY) AS events_30d,
              count(event_timestamp) AS events_90d
       FROM snapshot_dates_120 s LEFT JOIN stg_events e
         ON e.customer_id = s.customer_id AND e.snapshot_date = s.snapshot_date
        AND event_timestamp <= s.snapshot_date AND event_timestamp > s.snapshot_date - INTERVAL 90 DAY
       GROUP BY s.customer_id, s.snapshot_date""",
)
step(
    "panel_ticket_features",
    ("snapshot_dates_120", "stg_support_tickets"),
    """SELECT s.customer_id, s.snapshot_date, count(created_at) AS support_tickets_90d,
              avg(resolution_days) AS avg_resolution_days_90d,
              CAST(datediff('day', max(created_at), s.snapshot_date) AS INTEGER) AS days_since_last_ticket
       FROM snapshot_dates_120 s LEFT JOIN stg_support_tickets t
         ON t.customer_id = s.customer_id AND t.snapshot_date = s.snapshot_date
        AND created_at <= s.snapshot_date AND created_at > s.snapshot_date - INTERVAL 90 DAY
       GROUP BY s.customer_id, s.snapshot_date""",
)
step(
    "churn_feature_panel",
    ("panel_order_features", "panel_event_features", "panel_ticket_features"),
    """SELECT customer_id, snapshot_date, days_since_last_order, frequency_180d, monetary_180d,
              CAST(orders_recent_90d AS DOUBLE) / nullif(orders_prior_90d, 0) AS order_trend_90d,
              CAST(cancelled_invoices_90d AS DOUBLE) / nullif(total_invoices_90d, 0) AS return_cancel_rate_90d,
              events_30d, events_90d,
              CAST(events_30d AS DOUBLE) / nullif(CAST(events_90d AS DOUBLE) / CAST(3.0 AS DOUBLE), 0) AS engagement_decay_30d,
              support_tickets_90d, avg_resolution_days_90d, days_since_last_ticket,
              1 - has_future_order AS churned_next_90d
       FROM panel_order_features JOIN panel_event_features USING (customer_id, snapshot_date)
       JOIN panel_ticket_features USING (customer_id, snapshot_date)""",
)

# --- marts -----------------------------------------------------------------------------------

step(
    "order_stats",
    ("completed_orders",),
    """SELECT customer_id, count(DISTINCT invoice_no) AS n,
              CAST(sum(CAST(total_revenue AS DECIMAL(20, 6))) AS DOUBLE) AS revenue,
              min(invoice_date) AS first_order_date, max(invoice_date) AS last_order_date
       FROM completed_orders GROUP BY customer_id""",
)
step(
    "customer_360",
    ("dim_customers", "order_stats"),
    """SELECT d.customer_id, d.country, s.first_order_date, s.last_order_date,
              s.n AS lifetime_order_count, s.revenue AS lifetime_revenue
       FROM dim_customers d LEFT JOIN order_stats s USING (customer_id)""",
)
step(
    "rfm_scores",
    ("order_stats",),
    """SELECT *, CAST(ntile(5) OVER (ORDER BY recency_days DESC NULLS FIRST, customer_id) AS INTEGER) AS r_score,
              CAST(ntile(5) OVER (ORDER BY frequency_lifetime NULLS LAST, customer_id) AS INTEGER) AS f_score,
              CAST(ntile(5) OVER (ORDER BY monetary_lifetime NULLS LAST, customer_id) AS INTEGER) AS m_score
       FROM (SELECT customer_id,
                    CAST(datediff('day', last_order_date, (SELECT max(invoice_date) FROM completed_orders)) AS INTEGER) AS recency_days,
                    n AS frequency_lifetime, revenue AS monetary_lifetime,
                    CASE WHEN n > 1 THEN CAST(datediff('day', first_order_date, last_order_date) AS DOUBLE) / (n - 1) END
                        AS avg_purchase_interval
             FROM order_stats)""",
)
step(
    "rfm_segments",
    ("rfm_scores",),
    """SELECT *, r_score + f_score + m_score AS rfm_score,
              CASE WHEN f_score >= 4 AND r_score >= 4 THEN 'champions'
                   WHEN f_score >= 4 THEN 'loyal'
                   WHEN r_score <= 2 AND f_score = 3 THEN 'at_risk'
                   WHEN r_score <= 2 THEN 'hibernating'
                   WHEN r_score >= 4 AND f_score < 3 THEN 'new'
                   ELSE 'standard' END AS segment
       FROM rfm_scores""",
)
step(
    "customer_profile",
    ("customer_360", "rfm_segments"),
    """SELECT customer_id, country, first_order_date, last_order_date, lifetime_order_count, lifetime_revenue,
              recency_days, frequency_lifetime, monetary_lifetime, avg_purchase_interval, segment, rfm_score
       FROM customer_360 JOIN rfm_segments USING (customer_id)""",
)

step(
    "cut",
    ("churn_feature_panel",),
    """SELECT dates[CAST(floor(len(dates) * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE))) AS INTEGER) + 1] AS cutoff
       FROM (SELECT list_sort(list_distinct(list(snapshot_date))) AS dates FROM churn_feature_panel)""",
)

FEATURES = """customer_id, snapshot_date, frequency_180d, monetary_180d, order_trend_90d,
    return_cancel_rate_90d, events_30d, events_90d, engagement_decay_30d, support_tickets_90d,
    avg_resolution_days_90d, days_since_last_ticket, churned_next_90d"""


# --- fixed score -----------------------------------------------------------------------------

step(
    "scored_panel",
    ("churn_feature_panel",),
    """SELECT *, floor(1 / (1 + frequency_180d + coalesce(monetary_180d, 0) / CAST(100000 AS DOUBLE)
                        + CAST(customer_id * 37 % 1009 AS DOUBLE) / 1009) * 1000000 + 0.5) / 1000000 AS churn_probability
       FROM churn_feature_panel""",
)
step(
    "scored_latest",
    ("scored_panel",),
    "SELECT * FROM scored_panel QUALIFY snapshot_date = max(snapshot_date) OVER (PARTITION BY customer_id)",
)
step(
    "predictions",
    ("scored_latest",),
    """SELECT customer_id, snapshot_date, churn_probability,
              CASE WHEN churn_probability <= edges[1] THEN 'low' WHEN churn_probability <= edges[2] THEN 'medium'
                   ELSE 'high' END AS risk_band,
              TIMESTAMP '2024-06-01' AS scored_at
       FROM scored_latest, (SELECT quantile_cont(churn_probability, [1 / 3, 2 / 3]) AS edges FROM scored_latest)""",
)
step(
    "high_risk",
    ("predictions",),
    "SELECT customer_id, snapshot_date, churn_probability FROM predictions WHERE risk_band = 'high'",
)
step(
    "confusion",
    ("scored_panel",),
    """SELECT CAST(count(*) FILTER (WHERE hit AND actual) AS DOUBLE) AS tp,
              CAST(count(*) FILTER (WHERE hit AND NOT actual) AS DOUBLE) AS fp,
              CAST(count(*) FILTER (WHERE NOT hit AND actual) AS DOUBLE) AS fn,
              CAST(count(*) FILTER (WHERE NOT hit AND NOT actual) AS DOUBLE) AS tn
       FROM (SELECT churn_probability >= 0.5 AS hit, churned_next_90d = 1 AS actual FROM scored_panel)""",
)
step(
    "class_lines",
    ("confusion",),
    """SELECT '0' AS label, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r,
              coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS n FROM confusion
       UNION ALL
       SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
              coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM confusion""",
)
step(
    "report_lines",
    ("class_lines",),
    """SELECT * FROM class_lines
       UNION ALL SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn),
                        (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM confusion
       UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(n) FROM class_lines
       UNION ALL SELECT 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(f * n) / sum(n), sum(n)
                 FROM class_lines""",
)

# --- offers ----------------------------------------------------------------------------------

step(
    "purchased",
    ("fct_order_lines", "dim_products"),
    """SELECT customer_id, product_id, d.description, max(invoice_date) AS last_purchased_at
       FROM fct_order_lines l JOIN dim_products d ON l.stock_code = d.product_id GROUP BY ALL""",
)
step(
    "candidates",
    ("purchased",),
    """SELECT customer_id, product_id, description,
              CAST(row_number() OVER (PARTITION BY customer_id
                   ORDER BY last_purchased_at DESC NULLS FIRST, product_id) AS INTEGER) AS position
       FROM purchased QUALIFY position <= 15""",
)
step(
    "fallback",
    ("purchased", "dim_customers"),
    """SELECT customer_id, product_id, description, position
       FROM (SELECT customer_id FROM dim_customers ANTI JOIN purchased USING (customer_id)) AS c,
            (SELECT product_id, description, CAST(row_number() OVER (ORDER BY product_id) AS INTEGER) AS position
             FROM dim_products ORDER BY product_id LIMIT 15) AS p""",
)
step(
    "passages",
    (),
    """SELECT doc_id, unnest(pieces) AS passage, generate_subscripts(pieces, 1) - 1 AS n
       FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_extract_all(text, '(?s).{1,400}')
                                 ELSE regexp_extract_all(text, '(?s).{1,200}') END AS pieces FROM documents)""",
)
step(
    "proposals",
    ("passages",),
    """SELECT doc_id + (n // 3) * 1000000000 AS customer_id, CAST(n % 3 + 1 AS INTEGER) AS attempt,
              CASE WHEN (doc_id + n) % 17 NOT IN (3, 5, 7) THEN doc_id + (n // 3) * 1000000000 END AS offer_customer_id,
              CASE WHEN (doc_id + n) % 17 <> 3 THEN [0, 10, 15, 20, 5][(doc_id + n) % 5 + 1] END AS discount_pct,
              CASE WHEN (doc_id + n) % 17 = 3 THEN NULL WHEN (doc_id + n) % 7 = 6 THEN 'sms'
                   WHEN (doc_id + n) % 2 = 0 THEN 'email' ELSE 'push' END AS channel,
              CASE WHEN (doc_id + n) % 17 IN (3, 5) THEN NULL WHEN (doc_id + n) % 11 = 0 THEN 'none-such'
                   ELSE CAST((doc_id + n) % 200 AS VARCHAR) END AS product_focus,
              CASE WHEN (doc_id + n) % 17 NOT IN (3, 5) THEN
                  passage || CASE WHEN (doc_id + n) % 13 = 0 THEN ' call 555-123-4567' ELSE '' END END AS messaging,
              (doc_id + n) % 17 <> 3 AS is_object
       FROM passages""",
)
step(
    "checked",
    ("proposals", "dim_products"),
    r"""SELECT * EXCLUDE (is_object), CASE WHEN NOT is_object THEN 'malformed_json' ELSE concat_ws(',',
              CASE WHEN offer_customer_id IS NULL THEN 'customer_id' END,
              CASE WHEN discount_pct NOT IN (0, 10, 15, 20) THEN 'discount_pct' END,
              CASE WHEN channel NOT IN ('email', 'push') THEN 'channel' END,
              CASE WHEN product_focus IS NULL THEN 'product_focus' END,
              CASE WHEN product_focus NOT IN (SELECT product_id FROM dim_products) THEN 'unknown_product' END,
              CASE WHEN messaging IS NULL THEN 'messaging_missing' END,
              CASE WHEN length(messaging) > 300 THEN 'messaging_length' END,
              CASE WHEN contains(lower(messaging), 'damn') OR contains(lower(messaging), 'hell')
                     OR contains(lower(messaging), 'crap') THEN 'profanity' END,
              CASE WHEN regexp_matches(messaging, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN 'pii_email' END,
              CASE WHEN regexp_matches(messaging, '\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b') THEN 'pii_phone' END,
              CASE WHEN regexp_matches(messaging, '\b(?:\d[ -]*?){13,16}\b') THEN 'pii_card' END) END AS reasons
        FROM proposals""",
)
step("validated", ("checked",), "SELECT * EXCLUDE (reasons) FROM checked WHERE reasons = ''")
step(
    "first_valid",
    ("validated",),
    """SELECT * FROM validated WHERE attempt <= 3
       QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY attempt) = 1""",
)
step(
    "answers",
    ("checked",),
    """SELECT customer_id, attempt, bool_or(reasons = '') AS accepted, min(replace(reasons, ',', ', ')) AS feedback
       FROM checked GROUP BY customer_id, attempt""",
)
step(
    "asked",
    ("answers", "dim_customers"),
    """SELECT customer_id, CAST(1 AS INTEGER) AS attempt, CAST(NULL AS VARCHAR) AS feedback FROM dim_customers
       UNION ALL
       SELECT d.customer_id, 2, coalesce(a.feedback, 'no_answer')
       FROM dim_customers d LEFT JOIN answers a ON a.customer_id = d.customer_id AND a.attempt = 1
       WHERE NOT coalesce(a.accepted, false)
       UNION ALL
       SELECT d.customer_id, 3, coalesce(b.feedback, 'no_answer')
       FROM dim_customers d LEFT JOIN answers a ON a.customer_id = d.customer_id AND a.attempt = 1
       LEFT JOIN answers b ON b.customer_id = d.customer_id AND b.attempt = 2
       WHERE NOT coalesce(a.accepted, false) AND NOT coalesce(b.accepted, false)""",
)
step(
    "outcomes",
    ("high_risk", "rfm_segments", "first_valid"),
    """SELECT h.customer_id, r.customer_id IS NOT NULL AND f.customer_id IS NOT NULL AS succeeded
       FROM high_risk h LEFT JOIN rfm_segments r USING (customer_id) LEFT JOIN first_valid f USING (customer_id)""",
)
step(
    "interventions",
    ("outcomes",),
    """SELECT offer_customer_id AS customer_id, discount_pct, channel, product_focus, messaging
       FROM first_valid WHERE customer_id IN (SELECT customer_id FROM outcomes WHERE succeeded)""",
)
step(
    "fixed_explanations",
    ("scored_latest",),
    """SELECT customer_id, snapshot_date, churn_probability,
              list_sort([{rank: -abs(i1), pos: 0, name: 'frequency_180d', impact: i1},
                         {rank: -abs(i2), pos: 1, name: 'monetary_180d', impact: i2},
                         {rank: -abs(i3), pos: 2, name: 'order_trend_90d', impact: i3},
                         {rank: -abs(i4), pos: 3, name: 'customer_term', impact: i4}])[1:3] AS top_features
       FROM (SELECT customer_id, snapshot_date, churn_probability,
                    CAST(-frequency_180d AS DOUBLE) AS i1,
                    -coalesce(monetary_180d, 0) / CAST(100000 AS DOUBLE) AS i2,
                    coalesce(order_trend_90d, CAST(0 AS DOUBLE)) AS i3,
                    CAST(-(customer_id * 37 % 1009) AS DOUBLE) / 1009 AS i4
             FROM scored_latest)""",
)
step(
    "product_blocks",
    ("candidates", "fallback"),
    """SELECT customer_id, string_agg('- ' || product_id || ' (description: ' || coalesce(description, 'None') || ')',
                                      chr(10) ORDER BY position) AS products_block
       FROM (SELECT * FROM candidates UNION ALL SELECT * FROM fallback) GROUP BY customer_id""",
)
step(
    "dashboard",
    ("predictions", "customer_360", "rfm_segments"),
    """SELECT p.customer_id, p.snapshot_date, p.churn_probability, p.risk_band, c.country, c.lifetime_revenue,
              r.segment, r.frequency_lifetime
       FROM predictions p JOIN customer_360 c USING (customer_id) JOIN rfm_segments r USING (customer_id)""",
)
step(
    "risk_table",
    ("dashboard",),
    """SELECT customer_id, country, segment, risk_band, churn_probability, lifetime_revenue,
              CASE WHEN churn_probability >= 0.66 THEN 'High Risk' WHEN churn_probability >= 0.33 THEN 'Medium Risk'
                   ELSE 'Low Risk' END AS risk_label_fixed,
              CAST(round(CAST(churn_probability AS DECIMAL(9, 6)) * 100, 1) AS DECIMAL(5, 1)) || '%' AS probability_text,
              '$' || format('{:,.2f}', lifetime_revenue) AS revenue_text,
              CASE segment WHEN 'at_risk' THEN 'At_Risk' ELSE upper(segment[1]) || segment[2:] END AS segment_text
       FROM dashboard""",
)


def _json(*fields: tuple[str, str, bool]) -> str:
    """SQL for a JSON object: (name, SQL text value, quoted)."""
    parts = []
    for name, value, quoted in fields:
        shown = f"coalesce('\"' || {value} || '\"', 'null')" if quoted else f"coalesce(CAST({value} AS VARCHAR), 'null')"
        parts.append(f"'\"{name}\":' || {shown}")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


PROFILE_JSON = _json(
    ("customer_id", "p.customer_id", False),
    ("country", "country", True),
    ("first_order_date", _stamp("first_order_date"), True),
    ("last_order_date", _stamp("last_order_date"), True),
    ("lifetime_order_count", "lifetime_order_count", False),
    ("lifetime_revenue", "CAST(lifetime_revenue AS DECIMAL(20, 6))", False),
    ("recency_days", "recency_days", False),
    ("frequency_lifetime", "frequency_lifetime", False),
    ("monetary_lifetime", "CAST(monetary_lifetime AS DECIMAL(20, 6))", False),
    ("avg_purchase_interval", "CAST(avg_purchase_interval AS DECIMAL(20, 6))", False),
    ("segment", "segment", True),
    ("rfm_score", "rfm_score", False),
)
EXPLANATION_JSON = (
    "'{\"customer_id\":' || e.customer_id || ',\"snapshot_date\":\"' || strftime(e.snapshot_date, '%Y-%m-%d') "
    "|| '\",\"churn_probability\":' || CAST(CAST(churn_probability AS DECIMAL(20, 6)) AS DECIMAL(20, 4)) || ',\"top_features\":[' "
    "|| array_to_string(list_transform(top_features, lambda f: '{\"name\":\"' || f.name || '\",\"impact\":' "
    "|| CAST(round(f.impact, 4) AS DECIMAL(20, 4)) || '}'), ',') || ']}'"
)

# --- data quality ----------------------------------------------------------------------------


def _dq_sql() -> str:
    event_types = "('page_view', 'product_view', 'add_to_cart', 'login')"
    statuses = "('open', 'resolved')"
    segments = "('champions', 'loyal', 'at_risk', 'hibernating', 'new', 'standard')"
    scores, flags, labels = "(1, 2, 3, 4, 5)", "(true, false)", "(0, 1)"
    key = ["unique", "not_null"]
    # (table, step, severity, {column: checks})
    plan = [
        ("raw_invoices", "raw_invoices", "warn", {"CustomerID": ["not_null"]}),
        ("raw_events", "raw_events", "warn", {"customer_id": ["not_null"], "event_type": [event_types]}),
        ("raw_support_tickets", "raw_support_tickets", "warn", {"customer_id": ["not_null"], "status": [statuses]}),
        ("stg_invoices", "stg_invoices", "error", {"invoice_no": ["not_null"], "customer_id": ["not_null"], "is_cancelled": [flags]}),
        ("stg_events", "stg_events", "error", {"event_id": key, "customer_id": ["not_null"], "event_type": [event_types]}),
        ("stg_support_tickets", "stg_support_tickets", "error",
         {"ticket_id": key, "customer_id": ["not_null"], "status": [statuses], "resolution_days": ["not_null"]}),
        ("fct_order_lines", "fct_order_lines", "error", {"order_line_id": key, "customer_id": ["not_null"]}),
        ("fct_orders", "fct_orders", "error", {"invoice_no": key}),
        ("dim_customers", "dim_customers", "error", {"customer_id": key}),
        ("customer_snapshot_dates", "snapshot_dates_120", "error", {"customer_id": ["not_null"]}),
        ("churn_feature_panel", "churn_feature_panel", "error", {"churned_next_90d": [labels, "not_null"]}),
        ("dim_products", "dim_products", "error", {"product_id": key}),
        ("mart_customer_360", "customer_360", "error", {"customer_id": key}),
        ("mart_rfm_segments", "rfm_segments", "error",
         {"customer_id": key, "r_score": [scores], "f_score": [scores], "m_score": [scores], "segment": [segments]}),
        ("churn_features", "churn_feature_panel", "error", {"churned_next_90d": ["not_null", labels]}),
    ]
    selects = []
    for name, source, severity, columns in plan:
        for column, tests in columns.items():
            for test in tests:
                if test == "not_null":
                    failures = f"(SELECT count(*) FROM {source} WHERE {column} IS NULL)"
                elif test == "unique":
                    failures = (
                        f"(SELECT count(*) FROM (SELECT {column} FROM {source} WHERE {column} IS NOT NULL "
                        f"GROUP BY {column} HAVING count(*) > 1))"
                    )
                else:
                    failures = f"(SELECT count(DISTINCT {column}) FROM {source} WHERE {column} NOT IN {test})"
                kind = test if test in ("not_null", "unique") else "accepted_values"
                selects.append(
                    f"SELECT '{name}' AS table_name, '{column}' AS column_name, '{kind}' AS test, "
                    f"'{severity}' AS severity, {failures} AS failures"
                )
    body = " UNION ALL ".join(selects)
    return sql(f"SELECT *, failures = 0 AS passed FROM ({body})", *{p[1]: None for p in plan})


FEATURE_NAMES = """CASE f.name WHEN 'frequency_180d' THEN 'Frequency 180D' WHEN 'monetary_180d' THEN 'Monetary 180D'
    WHEN 'order_trend_90d' THEN 'Order Trend 90D' ELSE 'Customer Term' END"""

def oracle_sql() -> dict[str, str]:
    same_name = (
        "raw_invoices raw_events raw_support_tickets stg_invoices stg_events stg_support_tickets "
        "fct_order_lines fct_orders dim_customers dim_products completed_orders snapshot_bounds "
        "panel_order_features panel_event_features panel_ticket_features churn_feature_panel "
        "customer_360 rfm_segments customer_profile"
    ).split()
    out = {name: table(name) for name in same_name}
    out["incremental_panel"] = table("churn_feature_panel")
    out["snapshot_dates"] = table("snapshot_dates_60")
    out["snapshot_dates_long"] = table("snapshot_dates_120")
    out["churn_features"] = sql(f"SELECT {FEATURES} FROM churn_feature_panel", "churn_feature_panel")
    out["time_split_summary"] = sql(
        """SELECT CASE WHEN snapshot_date < cutoff THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows,
                  min(snapshot_date) AS first_date, max(snapshot_date) AS last_date
           FROM churn_feature_panel, cut GROUP BY split""",
        "cut",
    )
    out["class_weight"] = sql(
        """SELECT count(*) FILTER (WHERE churned_next_90d = 0) AS negatives,
                  count(*) FILTER (WHERE churned_next_90d = 1) AS positives,
                  CAST(negatives AS DOUBLE) / positives AS positive_weight
           FROM churn_feature_panel, cut WHERE snapshot_date < cutoff""",
        "cut",
    )
    out["label_balance"] = sql(
        """SELECT churned_next_90d, count(*) AS n_rows,
                  round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share
           FROM churn_feature_panel GROUP BY churned_next_90d""",
        "churn_feature_panel",
    )
    out["roc_auc"] = sql(
        """SELECT count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives,
                  round((sum(CASE WHEN y = 1 THEN rank2 END) - positives * (positives + 1)) / CAST(2 AS DOUBLE)
                        / positives / negatives, 6) AS roc_auc
           FROM (SELECT churned_next_90d AS y,
                        2 * rank() OVER (ORDER BY churn_probability)
                        + count(*) OVER (PARTITION BY churn_probability) - 1 AS rank2
                 FROM scored_panel)""",
        "scored_panel",
    )
    out["classification_report"] = sql(
        """SELECT label, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1_score,
                  CAST(n AS BIGINT) AS support FROM report_lines""",
        "report_lines",
    )
    out["calibration_table"] = sql(
        """SELECT CAST(1 + len(list_filter(inner_edges, lambda e: e < churn_probability)) AS INTEGER) AS bucket,
                  round(CAST(sum(CAST(churn_probability AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS mean_pred,
                  round(avg(churned_next_90d), 6) AS mean_actual, count(*) AS n_rows
           FROM scored_panel,
                (SELECT list_sort(list_distinct(quantile_cont(churn_probability,
                        [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])))[2:-2] AS inner_edges FROM scored_panel)
           GROUP BY bucket""",
        "scored_panel",
    )
    out["latest_snapshot"] = sql(f"SELECT {FEATURES} FROM scored_latest", "scored_latest")
    out["risk_bands"] = table("predictions")
    out["risk_band_distribution"] = sql(
        "SELECT risk_band, count(*) AS n_customers FROM predictions GROUP BY risk_band", "predictions"
    )
    out["high_risk_customers"] = table("high_risk")
    out["high_risk_top_n"] = sql(
        "SELECT * FROM high_risk ORDER BY churn_probability DESC, customer_id LIMIT 5", "high_risk"
    )
    out["highest_risk_row"] = sql(
        """SELECT customer_id, snapshot_date, churn_probability, churned_next_90d FROM scored_panel
           ORDER BY churn_probability DESC, customer_id, snapshot_date LIMIT 1""",
        "scored_panel",
    )
    out["score_lookup"] = sql(
        """SELECT c.customer_id, snapshot_date, churn_probability, risk_band, scored_at,
                  CASE WHEN p.customer_id IS NULL THEN 'no_score' ELSE 'ok' END AS status
           FROM dim_customers c LEFT JOIN predictions p USING (customer_id)""",
        "dim_customers",
        "predictions",
    )
    out["candidate_products"] = table("candidates")
    out["candidate_products_fallback"] = table("fallback")
    out["offer_context"] = sql(
        f"""SELECT p.customer_id, {PROFILE_JSON} AS profile_json, {EXPLANATION_JSON} AS explanation_json,
                   products_block, CAST(NULL AS VARCHAR) AS feedback
            FROM customer_profile p JOIN fixed_explanations e ON e.customer_id = p.customer_id
            JOIN product_blocks b ON b.customer_id = p.customer_id""",
        "customer_profile",
        "fixed_explanations",
        "product_blocks",
    )
    out["offer_context_feedback"] = sql(
        f"""SELECT p.customer_id, {PROFILE_JSON} AS profile_json, {EXPLANATION_JSON} AS explanation_json,
                   products_block, replace(k.reasons, ',', ', ') AS feedback
            FROM customer_profile p JOIN fixed_explanations e ON e.customer_id = p.customer_id
            JOIN product_blocks b ON b.customer_id = p.customer_id
            LEFT JOIN checked k ON k.customer_id = p.customer_id AND k.attempt = 1 AND k.reasons <> ''""",
        "customer_profile",
        "fixed_explanations",
        "product_blocks",
        "checked",
    )
    out["validated_offers"] = table("validated")
    out["rejected_offers"] = sql("SELECT * FROM checked WHERE reasons <> ''", "checked")
    out["valid_product_focus"] = sql(
        """SELECT customer_id, attempt, product_focus FROM proposals
           WHERE product_focus IN (SELECT product_id FROM dim_products)""",
        "proposals",
        "dim_products",
    )
    out["first_valid_attempt"] = table("first_valid")
    out["unprofiled_high_risk"] = sql(
        "SELECT * FROM high_risk ANTI JOIN customer_profile USING (customer_id)", "high_risk", "customer_profile"
    )
    out["intervention_outcomes"] = sql(
        """SELECT CASE WHEN succeeded THEN 'succeeded' ELSE 'failed' END AS result, count(*) AS n_customers
           FROM outcomes GROUP BY result""",
        "outcomes",
    )
    out["interventions"] = table("interventions")
    out["dashboard_predictions"] = table("dashboard")
    out["kpi_summary"] = sql(
        """SELECT count(*) AS customers_scored, count(*) FILTER (WHERE risk_band = 'high') AS high_risk,
                  round(CAST(sum(CAST(churn_probability AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS mean_probability,
                  CAST(round(CAST(mean_probability AS DECIMAL(9, 6)) * 100, 2) AS DECIMAL(6, 2)) || '%' AS mean_probability_text,
                  (SELECT count(*) FROM interventions) AS interventions
           FROM predictions""",
        "predictions",
        "interventions",
    )
    out["filter_options"] = sql(
        "SELECT 'segment' AS field, segment AS value FROM dashboard UNION SELECT 'risk_band', risk_band FROM dashboard",
        "dashboard",
    )
    out["risk_table"] = table("risk_table")
    out["risk_table_filtered"] = sql(
        """SELECT * FROM risk_table WHERE segment IN ('champions', 'at_risk')
           AND risk_band IN ('high', 'medium')""",
        "risk_table",
    )
    out["explanation_table"] = sql(
        f"""SELECT customer_id, snapshot_date,
                   CASE WHEN churn_probability >= 0.66 THEN 'High Risk' WHEN churn_probability >= 0.33
                        THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_label_fixed,
                   CAST(position AS INTEGER) AS position, {FEATURE_NAMES} AS feature, round(f.impact, 4) + 0.0 AS impact,
                   CASE WHEN f.impact > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction,
                   CASE WHEN f.impact < 0 THEN '-' ELSE '+' END
                       || CAST(CAST(abs(round(f.impact, 4)) AS DECIMAL(20, 4)) AS DECIMAL(20, 2)) AS impact_text
            FROM (SELECT *, unnest(top_features) AS f, generate_subscripts(top_features, 1) AS position
                  FROM fixed_explanations)""",
        "fixed_explanations",
    )
    out["profile_display"] = sql(
        """SELECT customer_id, CASE segment WHEN 'at_risk' THEN 'At_Risk' ELSE upper(segment[1]) || segment[2:] END AS segment,
                  lifetime_order_count, '$' || format('{:,.2f}', lifetime_revenue) AS lifetime_revenue, recency_days,
                  country, rfm_score,
                  CAST(round(CAST(avg_purchase_interval AS DECIMAL(20, 6)), 1) AS DECIMAL(20, 1)) || ' days'
                      AS avg_purchase_interval,
                  strftime(first_order_date, '%Y-%m-%d') AS first_order
           FROM customer_profile""",
        "customer_profile",
    )
    layers = {t: t for t in """stg_invoices stg_events stg_support_tickets fct_order_lines fct_orders dim_customers
        dim_products churn_feature_panel""".split()}
    layers |= {
        "customer_snapshot_dates": "snapshot_dates_120",
        "mart_customer_360": "customer_360",
        "mart_rfm_segments": "rfm_segments",
        "churn_features": "churn_feature_panel",
    }
    out["published_layers"] = sql(
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {of}" for t, of in layers.items()),
        *dict.fromkeys(layers.values()),
    )
    out["lowered_names"] = sql(
        """SELECT "InvoiceNo" AS invoiceno, "StockCode" AS stockcode, "Description" AS description, "Quantity" AS quantity,
                  "InvoiceDate" AS invoicedate, "UnitPrice" AS unitprice, "CustomerID" AS customerid, "Country" AS country,
                  source_sheet FROM raw_invoices""",
        "raw_invoices",
    )
    out["feature_columns"] = sql(
        """SELECT frequency_180d, monetary_180d, order_trend_90d, return_cancel_rate_90d, events_30d, events_90d,
                  engagement_decay_30d, support_tickets_90d, avg_resolution_days_90d, days_since_last_ticket
           FROM churn_feature_panel""",
        "churn_feature_panel",
    )
    out["landed_events"] = table("raw_events")
    out["stored_predictions"] = table("predictions")
    out["stored_interventions"] = sql(
        "SELECT *, TIMESTAMP '2024-06-01' AS generated_at FROM interventions", "interventions"
    )
    out["dq_report"] = _dq_sql()
    out["shift_years"] = sql(
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shifted FROM shifted_orders",
        "shifted_orders",
    )
    out["raw_union"] = table("raw_invoices")
    out["ingested_invoices"] = sql(
        """SELECT * REPLACE (replace("Description", ' ', chr(10)) AS "Description")
           FROM raw_invoices WHERE "InvoiceDate" <> 'not-a-date'""",
        "raw_invoices",
    )
    out["model_checks"] = sql(
        """SELECT 'scored_customers' AS name, count(DISTINCT customer_id) AS n FROM snapshot_dates_120
           UNION ALL SELECT unnest(['probability_out_of_range', 'loaded_model_differs', 'impacts_off_log_odds']), 0""",
        "snapshot_dates_120",
    )
    out["explain_report"] = sql(
        f"""SELECT customer_id, status, CASE WHEN status = 'ok' THEN profile_json END AS profile_json,
                   CASE WHEN status = 'ok' THEN explanation_json END AS explanation_json,
                   CASE WHEN status = 'ok' THEN offer_customer_id END AS offer_customer_id,
                   CASE WHEN status = 'ok' THEN attempt END AS attempt,
                   CASE WHEN status = 'ok' THEN discount_pct END AS discount_pct,
                   CASE WHEN status = 'ok' THEN channel END AS channel,
                   CASE WHEN status = 'ok' THEN product_focus END AS product_focus,
                   CASE WHEN status = 'ok' THEN messaging END AS messaging
            FROM (SELECT d.customer_id, p.profile_json, e.explanation_json, f.* EXCLUDE (customer_id),
                         CASE WHEN p.customer_id IS NULL THEN 'no_profile' WHEN e.customer_id IS NULL THEN 'no_panel_row'
                              WHEN f.customer_id IS NULL THEN 'no_valid_offer' ELSE 'ok' END AS status
                  FROM dim_customers d
                  LEFT JOIN (SELECT customer_id, {PROFILE_JSON} AS profile_json FROM customer_profile p) p
                      ON p.customer_id = d.customer_id
                  LEFT JOIN (SELECT customer_id, {EXPLANATION_JSON} AS explanation_json FROM fixed_explanations e) e
                      ON e.customer_id = d.customer_id
                  LEFT JOIN first_valid f ON f.customer_id = d.customer_id)""",
        "dim_customers",
        "customer_profile",
        "fixed_explanations",
        "first_valid",
    )
    out["retry_requests"] = sql(
        f"""SELECT p.customer_id, a.attempt, {PROFILE_JSON} AS profile_json, {EXPLANATION_JSON} AS explanation_json,
                   products_block, a.feedback
            FROM customer_profile p JOIN fixed_explanations e ON e.customer_id = p.customer_id
            JOIN product_blocks b ON b.customer_id = p.customer_id JOIN asked a ON a.customer_id = p.customer_id""",
        "customer_profile",
        "fixed_explanations",
        "product_blocks",
        "asked",
    )
    out["retention_outcomes"] = sql(
        f"""SELECT h.customer_id, h.snapshot_date, h.churn_probability,
                   CASE WHEN p.customer_id IS NULL THEN 'no_profile' WHEN e.customer_id IS NULL THEN 'no_panel_row'
                        WHEN f.customer_id IS NULL THEN 'no_valid_offer' ELSE 'succeeded' END AS status,
                   CASE WHEN p.customer_id IS NOT NULL AND e.customer_id IS NOT NULL THEN coalesce(f.attempt, 3) END AS attempts,
                   CASE WHEN p.customer_id IS NOT NULL THEN e.explanation_json END AS explanation_json,
                   f.discount_pct, f.channel, f.product_focus, f.messaging
            FROM high_risk h LEFT JOIN customer_profile p ON p.customer_id = h.customer_id
            LEFT JOIN (SELECT customer_id, {EXPLANATION_JSON} AS explanation_json FROM fixed_explanations e) e
                ON e.customer_id = h.customer_id
            LEFT JOIN first_valid f ON f.customer_id = h.customer_id AND p.customer_id IS NOT NULL AND e.customer_id IS NOT NULL""",
        "high_risk",
        "customer_profile",
        "fixed_explanations",
        "first_valid",
    )
    return out
