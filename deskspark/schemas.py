"""Declared schemas of every table the engine reads or writes, as DDL texts."""

from __future__ import annotations


def names(ddl: str) -> list[str]:
    """Column names of a flat DDL text."""
    return [part.split()[0] for part in ddl.split(",")]


EMAIL = (
    "id string, sender string, subject string, body string, received_at timestamp_ntz,"
    " thread_id string"
)
EMAIL_JSON = ("id string, sender string, subject string, body string")
HEADERS = ("headers array<struct<name: string, value: string>>")
PARTS = ("message_id string, part_no int, mime_type string, data string")
CUSTOMERS = (
    "customer_id string, email string, name string, status string, created_at string"
)
SUBSCRIPTIONS = (
    "subscription_id string, customer_id string, plan_name string, plan_price double,"
    " billing_cycle string, status string, is_active int, next_billing_date string,"
    " created_at string"
)
PAYMENTS = (
    "payment_id string, customer_id string, payment_method string, last_payment_date string,"
    " last_payment_amount double"
)
INVOICES = (
    "invoice_id string, customer_id string, invoice_number string, amount double, status string,"
    " created_at string, due_date string, paid_date string"
)
USAGE = (
    "usage_id string, customer_id string, current_usage string, plan_limits string,"
    " reset_date string, updated_at string"
)
CUSTOMER_TABLES = {
    "customers": CUSTOMERS,
    "subscriptions": SUBSCRIPTIONS,
    "payments": PAYMENTS,
    "invoices": INVOICES,
    "usage": USAGE,
}
CHUNKS = (
    "chunk_id string, content string, source string, header_1 string, header_2 string,"
    " header_3 string, category string, priority string, doc_type string"
)
CLASSIFICATION = ("category string, priority string, confidence double, reasoning string")
QA_MODEL = (
    "approved boolean, quality_score double, issues array<string>, suggestions array<string>,"
    " tone_assessment string, reasoning string"
)
VIOLATION = "struct<check_type: string, severity: string, message: string, action: string>"
CACHE = (
    "cache_key string, subject string, body string, category string, response string,"
    " qa_score double, ts timestamp_ntz, inserted_at timestamp_ntz, metadata map<string, string>"
)
METRICS = (
    "email_id string, category string, priority string, total_time double,"
    " classification_time double, retrieval_time double, generation_time double, qa_time double,"
    " qa_score double, qa_approved boolean, revision_count int, docs_retrieved int,"
    " used_cache boolean, used_reranking boolean, used_hybrid boolean, status string"
)
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string"
)
