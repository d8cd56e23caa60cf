"""Results depend on these exact lists, limits and patterns."""

# Feature panel
LOOKBACK_DAYS = 180
RECENT_DAYS = 90
ENGAGEMENT_DAYS = 30
HORIZON_DAYS = 90
MAX_MONTHS = 60

ID_COLUMNS = ("customer_id", "snapshot_date")
LABEL_COLUMN = "churned_next_90d"
FEATURE_COLUMNS = (
    "frequency_180d",
    "monetary_180d",
    "order_trend_90d",
    "return_cancel_rate_90d",
    "events_30d",
    "events_90d",
    "engagement_decay_30d",
    "support_tickets_90d",
    "avg_resolution_days_90d",
    "days_since_last_ticket",
)
# These columns leak the label and may not reach a model.
FORBIDDEN_COLUMNS = ("days_since_last_order", "avg_purchase_interval")

# Accepted values
EVENT_TYPES = ("page_view", "product_view", "add_to_cart", "login")
TICKET_STATUSES = ("open", "resolved")
SEGMENTS = ("champions", "loyal", "at_risk", "hibernating", "new", "standard")
RISK_BANDS = ("low", "medium", "high")

# Model
HOLDOUT_FRACTION = 0.2
TREES = 300
TREE_DEPTH = 4
LEARNING_RATE = 0.05
PATIENCE = 20
SEED = 42
TOP_FEATURES = 3

# Retention offers
DISCOUNT_TIERS = (0, 10, 15, 20)
CHANNELS = ("email", "push")
MAX_MESSAGE_CHARS = 300
MAX_ATTEMPTS = 3
CANDIDATE_PRODUCTS = 15
BLOCKED_WORDS = ("damn", "hell", "crap")
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "card": r"\b(?:\d[ -]*?){13,16}\b",
}

# Text that stands for NULL inside a surrogate key
NULL_KEY_PART = "_dbt_utils_surrogate_key_null_"

# Report labels
FIXED_LABEL_CUTS = ((0.66, "High Risk"), (0.33, "Medium Risk"))
FIXED_LABEL_REST = "Low Risk"

# Landing layout below the base URI
LANDING_KEYS = {
    "raw_invoices": "raw/invoices",
    "raw_events": "raw/events",
    "raw_support_tickets": "raw/support_tickets",
}

# The characters that count as white space in Unicode and at the ends of texts here.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
