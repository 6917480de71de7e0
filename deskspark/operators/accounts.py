"""Customer account lookups: joins, typed rows, newest invoices, summaries, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from deskspark.functions import text as X
from deskspark.settings import DEFAULTS, Settings


def active_accounts(
    customers: DataFrame, subscriptions: DataFrame, payments: DataFrame, usage: DataFrame
) -> DataFrame:
    """One row per customer that has an active subscription, newest subscription first.

    Each side is cut to one row per customer by partial aggregation before it is joined, so a
    customer with very many rows neither multiplies the result nor fills one task. The joins
    share the customer_id partitioning; small sides are left to Spark's own size check.
    """
    def newest(df: DataFrame, order: Column, keep: list[str]) -> DataFrame:
        row = F.max_by(F.struct(*keep), order).alias("r")
        return df.groupBy("customer_id").agg(row).select("customer_id", "r.*")

    plan = newest(
        subscriptions.filter("is_active = 1"),
        F.struct("next_billing_date", "subscription_id"),
        ["subscription_id", "plan_name", "plan_price", "billing_cycle", "next_billing_date"],
    )
    paid = newest(
        payments, F.struct("last_payment_date", "payment_id"),
        ["payment_method", "last_payment_date", "last_payment_amount"],
    )
    used = newest(usage, F.struct("usage_id"), ["current_usage", "plan_limits"])
    return (
        customers.select("customer_id", "email", "name", "status", "created_at")
        .join(plan, "customer_id")
        .join(paid, "customer_id", "left")
        .join(used, "customer_id", "left")
    )


def one_per_address(accounts: DataFrame) -> DataFrame:
    """Of several customers with one e-mail the smallest customer_id, so a lookup never doubles a mail."""
    row = F.min_by(F.struct(*accounts.columns), F.col("customer_id")).alias("r")
    return accounts.groupBy("email").agg(row).select("r.*")


def account_360(mails: DataFrame, accounts: DataFrame, address: str = "sender") -> DataFrame:
    """Mails joined to the account whose e-mail equals the sender, case-sensitively."""
    accounts = one_per_address(accounts)
    return mails.join(accounts, mails[address] == accounts["email"])


def typed_accounts(accounts: DataFrame, strict: bool = True) -> DataFrame:
    """ISO texts to timestamps, JSON maps to maps, zero payments to NULL.

    In strict mode an account with an unreadable required field is dropped, as if not found.
    """
    def stamp(name: str) -> Column:
        return F.try_to_timestamp(F.col(name)).cast("timestamp_ntz")

    def usage_map(name: str) -> Column:
        return F.from_json(F.col(name), "map<string,double>", {"mode": "PERMISSIVE"})

    out = accounts.withColumns({
        "created_at": stamp("created_at"),
        "next_billing_date": stamp("next_billing_date"),
        "last_payment_date": stamp("last_payment_date"),
        "last_payment_amount": F.nullif(F.col("last_payment_amount").cast("double"), F.lit(0.0)),
        "current_usage": usage_map("current_usage"),
        "plan_limits": usage_map("plan_limits"),
    })
    if strict:
        out = out.dropna(
            subset=["created_at", "next_billing_date", "plan_price", "current_usage", "plan_limits"]
        )
    return out


def recent_invoices(invoices: DataFrame, k: int = 5) -> DataFrame:
    """Newest k invoices per customer. The rank limit is applied before the shuffle as well."""
    w = W.partitionBy("customer_id").orderBy(F.desc("created_at"), F.desc("invoice_id"))
    return invoices.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def plain_number(c: Column) -> Column:
    """Double as text without a trailing .0, so whole numbers read as in JSON input."""
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", ""))


def usage_lines(current: Column, limits: Column) -> Column:
    """`key: used/limit` per usage key; a key without a limit is unlimited."""
    def line(entry: Column, limit: Column) -> Column:
        allowed = F.coalesce(plain_number(F.try_element_at(limit, entry["key"])), F.lit("unlimited"))
        return F.concat(entry["key"], F.lit(": "), plain_number(entry["value"]), F.lit("/"), allowed)

    return X.let(limits, lambda limit: F.transform(
        F.array_sort(F.map_entries(current)), lambda entry: line(entry, limit)))


def days_between(later: Column, now: Column) -> Column:
    """Whole days by floor of the interval; one hour ago is -1."""
    seconds = F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))
    return F.floor(seconds / 86400).cast("bigint")


def account_summary(as_of: Column) -> Column:
    """Account facts as plain text lines, from the columns of a typed account row."""
    def day(name: str) -> Column:
        return F.date_format(F.col(name), "yyyy-MM-dd")

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Status: "), F.upper("status")),
        F.concat(F.lit("Customer: "), F.col("name")),
        F.concat(F.lit("Address: "), F.col("email")),
        F.concat(F.lit("Since: "), day("created_at")),
        F.concat(F.lit("Plan: "), F.col("plan_name"), F.lit(" at $"),
                 F.format_string("%.2f", F.col("plan_price")), F.lit("/"), F.col("billing_cycle")),
        F.concat(F.lit("Next billing: "), day("next_billing_date"), F.lit(" ("),
                 days_between(F.col("next_billing_date"), as_of), F.lit(" days)")),
        F.concat(F.lit("Pays by: "), F.coalesce("payment_method", F.lit("N/A"))),
        F.concat(F.lit("Last payment: $"),
                 F.format_string("%.2f", F.coalesce("last_payment_amount", F.lit(0.0))),
                 F.lit(" on "), F.coalesce(day("last_payment_date"), F.lit("N/A"))),
        F.concat(F.lit("Usage: "),
                 F.array_join(usage_lines(F.col("current_usage"), F.col("plan_limits")), "; ")),
    )


def context_source(mails: DataFrame, account_text: DataFrame, document_text: DataFrame) -> DataFrame:
    """Account text where the lookup hit, else retrieved documents, else an empty context."""
    joined = mails.join(account_text, "id", "left").join(document_text, "id", "left")
    return joined.withColumns({
        "context": F.coalesce("account_context", "document_context", F.lit("")),
        "context_from": F.when(F.col("account_context").isNotNull(), F.lit("database"))
        .when(F.col("document_context").isNotNull(), F.lit("documents")).otherwise(F.lit("none")),
    })


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row."""
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL counts of the columns declared NOT NULL, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "nulls")


def fresh_snapshots(
    mails: DataFrame, snapshots: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Mails with the newest stored account snapshot that is still within its lifetime.

    Time is cut into buckets one lifetime long. A mail takes the last snapshot before it in its
    own (address, bucket) group, else the newest of the bucket before, of which one row was kept
    by pre-aggregation. Even an address that sends a third of all mail is spread over its
    buckets, and no pairs of mails and snapshots are built.
    """
    ttl = settings.account_ttl_seconds

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / ttl)

    stored = snapshots.select(
        "email", bucket(F.col("cached_at")).alias("_bucket"), F.col("cached_at").alias("_at"),
        F.struct("cached_at", "snapshot_id").alias("_snap"),
    )
    asked = mails.select(
        "id", "email", bucket(F.col("received_at")).alias("_bucket"),
        F.col("received_at").alias("_at"),
    )
    line = (
        W.partitionBy("email", "_bucket")
        .orderBy("_at", F.col("id").isNotNull(), "_snap")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    both = asked.unionByName(stored, allowMissingColumns=True)
    within = both.withColumn("_last", F.last("_snap", ignorenulls=True).over(line)).filter("id IS NOT NULL")
    before = stored.groupBy("email", (F.col("_bucket") + 1).alias("_bucket")).agg(
        F.max("_snap").alias("_before")
    )
    found = within.join(before, ["email", "_bucket"], "left").select(
        "id", "_at", F.coalesce("_last", "_before").alias("_hit")
    )
    alive = F.col("_hit.cached_at") >= F.col("_at") - F.make_dt_interval(secs=F.lit(float(ttl)))
    return found.filter(alive).select("id", "_hit.cached_at", "_hit.snapshot_id")
