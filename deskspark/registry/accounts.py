"""Account queries: customers, subscriptions (orders), payments, invoices and usage (lineitem)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from deskspark import sql_access
from deskspark.operators import accounts as A
from deskspark.registry import register
from deskspark.registry.views import table
from deskspark.settings import DEFAULTS

ACCOUNT_SQL = """WITH customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, 'user' || c_custkey || '@example.com' AS email,
    c_name AS name, CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status,
    strftime(TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS created_at
  FROM customer),
subscriptions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS subscription_id, CAST(o_custkey AS VARCHAR) AS customer_id,
    o_orderpriority AS plan_name, o_totalprice AS plan_price,
    CASE WHEN o_orderkey % 2 = 0 THEN 'monthly' ELSE 'yearly' END AS billing_cycle,
    CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_active,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS next_billing_date FROM orders),
payments AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS payment_id, CAST(o_custkey AS VARCHAR) AS customer_id,
    'card ' || (o_orderkey % 4) AS payment_method, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS last_payment_date,
    CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS last_payment_amount
  FROM orders WHERE o_orderstatus = 'F'),
usage AS (
  SELECT customer_id AS usage_id, customer_id,
    CASE WHEN k % 10 = 0 THEN 'oops' ELSE '{"A":' || a || ',"N":' || n || ',"R":' || r || '}' END AS current_usage,
    '{"A":500,"R":' || (100 + k % 50) || '}' AS plan_limits, a, n, r, k
  FROM (SELECT o_custkey AS k, CAST(o_custkey AS VARCHAR) AS customer_id,
      CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS BIGINT) AS a,
      CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS BIGINT) AS n,
      CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT) AS r
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)),
accounts AS (
  SELECT c.*, s.subscription_id, s.plan_name, s.plan_price, s.billing_cycle, s.next_billing_date,
    p.payment_method, p.last_payment_date, p.last_payment_amount, u.current_usage, u.plan_limits, u.a, u.n, u.r, u.k
  FROM customers c
  JOIN (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY next_billing_date DESC, subscription_id DESC) rn
        FROM subscriptions WHERE is_active = 1) s ON s.customer_id = c.customer_id AND s.rn = 1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY last_payment_date DESC, payment_id DESC) rn
        FROM payments) p ON p.customer_id = c.customer_id AND p.rn = 1
  LEFT JOIN usage u ON u.customer_id = c.customer_id)
"""


def iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    since = F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        days=(F.col("c_custkey") % 900).cast("int"))
    return c.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, F.lit("suspended")).otherwise(F.lit("active")).alias("status"),
        iso(since).alias("created_at"),
    )


def subscriptions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("subscription_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderpriority").alias("plan_name"), F.col("o_totalprice").alias("plan_price"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("monthly")).otherwise(F.lit("yearly")).alias("billing_cycle"),
        (F.col("o_orderstatus") == "O").cast("int").alias("is_active"),
        iso(F.col("o_orderdate")).alias("next_billing_date"),
    )


def payments(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("payment_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit("card "), F.col("o_orderkey") % 4).alias("payment_method"),
        iso(F.col("o_orderdate")).alias("last_payment_date"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("last_payment_amount"),
    )


def usage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")

    def total(flag):
        return F.coalesce(
            F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))), F.lit(0)
        ).cast("bigint").alias(flag)

    # quantities are summed per order before the join, so only one row per order is shuffled
    per_order = li.groupBy("l_orderkey").agg(total("A"), total("N"), total("R"))
    per = o.join(per_order, o.o_orderkey == per_order.l_orderkey).groupBy("o_custkey").agg(
        *[F.sum(f).alias(f) for f in "ANR"]
    )
    key = F.col("o_custkey").cast("string")
    current = F.concat(F.lit('{"A":'), F.col("A"), F.lit(',"N":'), F.col("N"), F.lit(',"R":'), F.col("R"), F.lit("}"))
    return per.select(
        key.alias("usage_id"), key.alias("customer_id"),
        F.when(F.col("o_custkey") % 10 == 0, F.lit("oops")).otherwise(current).alias("current_usage"),
        F.concat(F.lit('{"A":500,"R":'), 100 + F.col("o_custkey") % 50, F.lit("}")).alias("plan_limits"),
    )


def accounts(spark, sf_dir):
    return A.active_accounts(*[f(spark, sf_dir) for f in (customers, subscriptions, payments, usage)])


@register("account_360", ACCOUNT_SQL + """
SELECT e.event_id, a.customer_id, a.email, name, status, created_at, plan_name, plan_price, billing_cycle,
  next_billing_date, payment_method, last_payment_date, last_payment_amount, current_usage, plan_limits
FROM events e JOIN accounts a ON a.email = 'user' || e.user_id || '@example.com'""")
def account_360(spark, sf_dir):
    """Every event is taken as a mail of its user."""
    m = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("sender")
    )
    return A.account_360(m, accounts(spark, sf_dir)).drop("sender", "subscription_id")


TYPED_SQL = ACCOUNT_SQL + """, typed AS (
  SELECT customer_id, email, name, status, CAST(created_at AS TIMESTAMP) AS created_at, plan_name, plan_price, billing_cycle,
    CAST(next_billing_date AS TIMESTAMP) AS next_billing_date, payment_method,
    CAST(last_payment_date AS TIMESTAMP) AS last_payment_date, nullif(last_payment_amount, 0) AS last_payment_amount,
    a, n, r, 100 + k % 50 AS r_limit FROM accounts WHERE current_usage IS NOT NULL AND current_usage <> 'oops')
"""


def typed(spark, sf_dir):
    return A.typed_accounts(accounts(spark, sf_dir))


@register("account_typed", TYPED_SQL + """
SELECT customer_id, created_at, next_billing_date, last_payment_date, last_payment_amount,
  CAST(a AS DOUBLE) AS used_a, CAST(n AS DOUBLE) AS used_n, CAST(r_limit AS DOUBLE) AS limit_r FROM typed""")
def account_typed(spark, sf_dir):
    return typed(spark, sf_dir).select(
        "customer_id", "created_at", "next_billing_date", "last_payment_date", "last_payment_amount",
        F.col("current_usage")["A"].alias("used_a"), F.col("current_usage")["N"].alias("used_n"),
        F.col("plan_limits")["R"].alias("limit_r"),
    )


@register("recent_invoices", """
SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS invoice_id,
    o_totalprice AS amount, o_orderdate AS created_at,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS INTEGER) AS rank
  FROM orders) WHERE rank <= 5""")
def recent_invoices(spark, sf_dir):
    inv = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderkey").cast("string").alias("invoice_id"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("created_at"),
    )
    return A.recent_invoices(inv)


USAGE_LINE_SQL = "'A: ' || a || '/500; N: ' || n || '/unlimited; R: ' || r || '/' || r_limit"


@register("usage_vs_limit", TYPED_SQL + f"SELECT customer_id, {USAGE_LINE_SQL} AS usage FROM typed")
def usage_vs_limit(spark, sf_dir):
    lines = A.usage_lines(F.col("current_usage"), F.col("plan_limits"))
    return typed(spark, sf_dir).select("customer_id", F.array_join(lines, "; ").alias("usage"))


@register("days_to_billing", """
SELECT o_orderkey, CAST(floor((epoch(o_orderdate) - epoch(TIMESTAMP '1998-06-15 12:30:00')) / 86400) AS BIGINT) AS days
FROM orders""")
def days_to_billing(spark, sf_dir):
    as_of = F.lit("1998-06-15 12:30:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", A.days_between(F.col("o_orderdate"), as_of).alias("days")
    )


SUMMARY_SQL = f"""'Status: ' || upper(status) || chr(10) || 'Customer: ' || name || chr(10) || 'Address: ' || email || chr(10)
  || 'Since: ' || strftime(created_at, '%Y-%m-%d') || chr(10)
  || 'Plan: ' || plan_name || ' at $' || printf('%.2f', plan_price) || '/' || billing_cycle || chr(10)
  || 'Next billing: ' || strftime(next_billing_date, '%Y-%m-%d') || ' (' ||
     CAST(floor((epoch(next_billing_date) - epoch(TIMESTAMP '1998-06-15 12:30:00')) / 86400) AS BIGINT) || ' days)' || chr(10)
  || 'Pays by: ' || coalesce(payment_method, 'N/A') || chr(10)
  || 'Last payment: $' || printf('%.2f', coalesce(last_payment_amount, 0.0)) || ' on '
     || coalesce(strftime(last_payment_date, '%Y-%m-%d'), 'N/A') || chr(10)
  || 'Usage: ' || {USAGE_LINE_SQL}"""


@register("account_context", TYPED_SQL + f"SELECT customer_id, {SUMMARY_SQL} AS context FROM typed")
def account_context(spark, sf_dir):
    as_of = F.lit("1998-06-15 12:30:00").cast("timestamp_ntz")
    return typed(spark, sf_dir).select("customer_id", A.account_summary(as_of).alias("context"))


@register("context_source", TYPED_SQL + f"""
, m AS (SELECT CAST(event_id AS VARCHAR) AS id, 'user' || user_id || '@example.com' AS email, event_id FROM events),
a AS (SELECT email, {SUMMARY_SQL} AS account_context FROM typed)
SELECT m.id, coalesce(account_context, d.text, '') AS context,
  CASE WHEN account_context IS NOT NULL THEN 'database' WHEN d.text IS NOT NULL THEN 'documents' ELSE 'none' END AS context_from
FROM m LEFT JOIN a USING (email) LEFT JOIN documents d ON d.doc_id = m.event_id""")
def context_source(spark, sf_dir):
    as_of = F.lit("1998-06-15 12:30:00").cast("timestamp_ntz")
    m = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("sender"),
    )
    texts = typed(spark, sf_dir).withColumn("account_context", A.account_summary(as_of))
    hits = A.account_360(m, texts).select("id", "account_context")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document_context")
    )
    return A.context_source(m, hits, docs).select("id", "context", "context_from")


@register("fk_orphans", """
SELECT DISTINCT 'orders.o_custkey' AS fk, o_custkey AS key FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT DISTINCT 'customer.c_custkey', c_custkey FROM customer c
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey AND o_orderstatus = 'O')
UNION ALL SELECT DISTINCT 'documents.doc_id', doc_id FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def fk_orphans(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")

    def keys(df, name, column):
        return df.select(F.lit(name).alias("fk"), F.col(column).alias("key")).distinct()

    return (
        keys(A.orphans(o, c, "o_custkey", "c_custkey"), "orders.o_custkey", "o_custkey")
        .unionByName(keys(A.orphans(c, o.filter("o_orderstatus = 'O'"), "c_custkey", "o_custkey"),
                          "customer.c_custkey", "c_custkey"))
        .unionByName(keys(A.orphans(d, lab.withColumnRenamed("doc_id", "label_doc"), "doc_id", "label_doc"),
                          "documents.doc_id", "doc_id"))
    )


@register("dup_keys", "SELECT md5(text) AS content, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("content"))
    return A.duplicate_keys(d, "content")


@register("null_audit", """
WITH a AS (SELECT l.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'quality' AS column_name, count(*) FILTER (WHERE quality IS NULL) AS nulls FROM a
UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM a""")
def null_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return A.missing_values(d, ["quality", "toxic"])


@register("insert_if_absent", """
SELECT doc_id, source_table FROM (SELECT doc_id, 'labels' AS source_table FROM labels
UNION ALL SELECT doc_id, 'documents' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))""")
def insert_if_absent(spark, sf_dir):
    from deskspark.sinks.tables import insert_if_absent as absent

    stored = table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("source_table"))
    new = table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("source_table"))
    return absent(stored, new, ["doc_id"])


@register("snapshot_ttl", """
WITH m AS (SELECT CAST(event_id AS VARCHAR) AS id, user_id, ts FROM events WHERE event_type <> 'view'),
s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
j AS (SELECT m.id, s.ts AS cached_at, CAST(s.event_id AS VARCHAR) AS snapshot_id,
    row_number() OVER (PARTITION BY m.id ORDER BY s.ts DESC, s.event_id DESC) AS rn
  FROM m JOIN s ON s.user_id = m.user_id AND s.ts <= m.ts AND s.ts >= m.ts - INTERVAL 21600 SECONDS)
SELECT id, cached_at, snapshot_id FROM j WHERE rn = 1""")
def snapshot_ttl(spark, sf_dir):
    """Views as account snapshots, other events as mails; six hours of lifetime."""
    e = table(spark, sf_dir, "events").withColumn("email", F.col("user_id").cast("string"))
    m = e.filter("event_type <> 'view'").select(F.col("event_id").cast("string").alias("id"), "email",
                                                F.col("ts").alias("received_at"))
    s = e.filter("event_type = 'view'").select("email", F.col("ts").alias("cached_at"),
                                               F.col("event_id").cast("string").alias("snapshot_id"))
    return A.fresh_snapshots(m, s, replace(DEFAULTS, account_ttl_seconds=21600))


@register("sql_accounts", TYPED_SQL + """
, e AS (SELECT event_id, 'user' || user_id || '@example.com' AS sender FROM events WHERE event_type <> 'view')
SELECT e.event_id, t.customer_id, t.plan_name, CAST(floor((epoch(t.next_billing_date) - epoch(TIMESTAMP '1998-06-15 12:30:00')) / 86400) AS BIGINT) AS days,
  CASE WHEN t.plan_price >= 8 THEN 'high' WHEN t.plan_price >= 5 THEN 'middle' WHEN t.plan_price IS NOT NULL THEN 'low' END AS band
FROM e JOIN typed t ON t.email = e.sender WHERE t.plan_price >= 5""")
def sql_accounts(spark, sf_dir):
    """Account lookup in SQL: views, a table function called for each mail, scalar functions and bound parameters."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("sender"))
    sql_access.publish(spark, accounts=A.one_per_address(typed(spark, sf_dir)), asking=events)
    return sql_access.ask(spark, """
        SELECT q.event_id, a.customer_id, a.plan_name, days_until(a.next_billing_date, cast(:now AS TIMESTAMP_NTZ)) AS days,
          score_band(a.plan_price) AS band
        FROM asking q, LATERAL account_of(q.sender) a WHERE q.event_type <> :kind AND a.plan_price >= :least""",
        now="1998-06-15 12:30:00", kind="view", least=5)
