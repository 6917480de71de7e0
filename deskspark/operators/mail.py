"""Mail intake and outgoing-mail columns: headers, senders, dates, bodies, threading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from deskspark.functions import text as X
from deskspark.rules import AUTOMATED_SENDER_TERMS, EXCLUDED_MAIL_TABS, NO_BODY


def header_value(headers: Column, name: str) -> Column:
    """First header of that name, any letter case."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.get(hits, F.lit(0))["value"]


def sender_address(raw: Column) -> Column:
    """Bracketed text, else the first address-like token, else the input."""
    return F.coalesce(
        X.blank_to_null(F.regexp_extract(raw, r"<(.+?)>", 1)),
        X.blank_to_null(F.regexp_extract(raw, r"[\w.-]+@[\w.-]+\.\w+", 0)),
        raw,
    )


def parse_mail_date(raw: Column, as_of: Column) -> Column:
    """RFC-style date; anything unreadable becomes the job's reference time."""
    bare = F.regexp_replace(raw, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), as_of)


def decode_part(data: Column) -> Column:
    """base64url to text; bad input gives an empty string."""
    raw = F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64"))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit(""))


def select_body(parts: DataFrame) -> DataFrame:
    """One body per message: last non-empty plain part, else last HTML part as text.

    A message of a single part is its body whatever its type.

    Partial aggregation keeps one candidate per message and map task, so a message with very
    many parts does not pile up in one task.
    """
    filled = parts.filter(F.col("data") != "").withColumn("content", decode_part(F.col("data")))
    plain = (F.col("mime_type") == "text/plain")
    html = (F.col("mime_type") == "text/html")
    latest = filled.groupBy("message_id").agg(
        F.max_by(F.when(plain, F.col("content")), F.when(plain, F.col("part_no"))).alias("plain"),
        F.max_by(F.when(html, F.col("content")), F.when(html, F.col("part_no"))).alias("html"),
        F.max_by("content", "part_no").alias("any"),
    )
    ids = parts.groupBy("message_id").agg(F.count("*").alias("n_parts"))
    body = F.coalesce(
        X.blank_to_null(F.col("plain")),
        F.when(F.col("html") != "", X.html_text(F.col("html"))),
        F.when((F.col("n_parts") == 1) & F.col("html").isNull(), X.blank_to_null(F.col("any"))),
        F.lit(NO_BODY),
    )
    return ids.join(latest, "message_id", "left").select("message_id", body.alias("body"))


def is_automated(sender: Column) -> Column:
    return X.contains_any(F.lower(sender), AUTOMATED_SENDER_TERMS)


def scan_unread(
    mails: DataFrame, seen: DataFrame | None = None, label: str = "INBOX",
    max_results: int | None = None,
) -> DataFrame:
    """Unread mail of one label that was not handled before; optionally one poll's worth."""
    out = mails.filter(
        F.array_contains("labels", "UNREAD") & F.array_contains("labels", label)
    )
    if seen is not None:
        out = out.join(seen.select("id").distinct(), "id", "left_anti")
    if max_results is not None:
        out = out.orderBy(F.desc("received_at"), "id").limit(max_results)
    return out


def scan_support(
    mails: DataFrame, seen: DataFrame | None = None, max_results: int | None = None
) -> DataFrame:
    """Unread inbox mail outside the excluded tabs and from non-automated senders."""
    tabs = F.array(*[F.lit(t) for t in EXCLUDED_MAIL_TABS])
    kept = mails.filter(
        ~F.arrays_overlap(F.col("tabs"), tabs)
        & ~is_automated(F.col("sender"))
    )
    return scan_unread(kept, seen, max_results=max_results)


def drop_automated(mails: DataFrame, column: str = "sender") -> DataFrame:
    return mails.filter(~is_automated(F.col(column)))


def dedup_ids(mails: DataFrame, id_column: str = "id", order_column: str | None = None) -> DataFrame:
    """One row per id. With an order column the earliest row is kept, so the result repeats."""
    if order_column is None:
        return mails.dropDuplicates([id_column])
    rest = [c for c in mails.columns if c != id_column]
    first = F.min_by(F.struct(*rest), F.col(order_column)).alias("row")
    return mails.groupBy(id_column).agg(first).select(id_column, "row.*")


def with_defaults(mails: DataFrame) -> DataFrame:
    return mails.withColumns({
        "subject": F.coalesce(X.blank_to_null(F.col("subject")), F.lit("No Subject")),
        "sender": F.coalesce(X.blank_to_null(F.col("sender")), F.lit("Unknown")),
        "thread_id": F.coalesce(X.blank_to_null(F.col("thread_id")), F.col("id")),
    })


def row_json(received_at: str = "received_at", *fields: str) -> Column:
    """One JSON text per mail, the timestamp in ISO form."""
    iso = F.date_format(F.col(received_at), "yyyy-MM-dd'T'HH:mm:ss").alias("received_at")
    return F.to_json(F.struct(*[F.col(f) for f in fields], iso))


def reply_subject(subject: Column, given: Column | None = None) -> Column:
    own = F.when(F.startswith(F.lower(subject), F.lit("re:")), subject).otherwise(
        F.concat(F.lit("Re: "), subject)
    )
    return own if given is None else F.coalesce(X.blank_to_null(given), own)


def recipient(sender: Column) -> Column:
    inner = F.substring_index(F.substring_index(sender, "<", 2), "<", -1)
    return F.when(F.contains(sender, F.lit("<")), F.substring_index(inner, ">", 1)).otherwise(sender)


def normalise_message_id(raw: Column) -> Column:
    bare = F.btrim(X.strip(raw), F.lit("<>"))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit("<"), bare, F.lit(">"))
    )


def reference_chain(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    """References, then In-Reply-To, then the own id: normalised, first occurrence kept."""
    listed = F.split(X.strip(F.coalesce(references, F.lit(""))), r"(?U)\s+")
    chain = F.concat(
        listed,
        F.array(F.coalesce(in_reply_to, F.lit("")), F.coalesce(message_id, F.lit(""))),
    )
    ids = F.transform(F.filter(chain, lambda r: r != ""), normalise_message_id)
    return F.array_join(F.array_distinct(ids), " ")


def thread_references(messages: DataFrame, own_id: Column) -> DataFrame:
    """References and In-Reply-To of each message from all messages before it in the thread.

    The chain holds every earlier id in order, whatever gaps the positions have; messages at the same
    position are in order of their ids. A message without a thread is in the thread named by its own id, and
    one without either stands alone. What is gathered per thread are its ids only, as each chain holds
    them anyway; a message gets the part before it by thread, position and id, so a long thread is not one task.
    """
    base = messages.withColumn("message_id", own_id).withColumn("__thread", F.coalesce("thread_id", "message_id"))
    threads = base.where("__thread IS NOT NULL").groupBy("__thread").agg(
        F.array_sort(F.collect_set(F.struct("position", "message_id"))).alias("__all"))
    ids = F.transform("__all", lambda m: m["message_id"])
    places = threads.select(F.col("__thread").alias("__key"), ids.alias("__ids"), F.posexplode("__all").alias("__n", "__at")) \
        .select("__key", "__at", F.slice("__ids", F.lit(1), F.col("__n")).alias("__part"))
    at = places["__at"]
    met = (base["__thread"] == places["__key"]) & base["position"].eqNullSafe(at["position"]) \
        & base["message_id"].eqNullSafe(at["message_id"])
    joined = base.join(places, met, "left").withColumn("__earlier", F.coalesce("__part", F.array().cast("array<string>")))
    return joined.withColumn("in_reply_to", F.try_element_at("__earlier", F.lit(-1))) \
        .withColumn("references", reference_chain(
            F.array_join("__earlier", " "), F.col("in_reply_to"), F.col("message_id"))) \
        .drop("__thread", "__key", "__at", "__part", "__earlier")


def normalise_body(body: Column) -> Column:
    return X.squeeze_blank_lines(X.strip(X.trim_lines(body)))


def outbox(replies: DataFrame) -> DataFrame:
    """Reply rows ready to be sent by whoever owns delivery."""
    return replies.select(
        "id",
        recipient(F.col("sender")).alias("to_address"),
        reply_subject(F.col("subject")).alias("subject"),
        normalise_message_id(F.col("message_id")).alias("in_reply_to"),
        reference_chain(
            F.col("references"), F.col("in_reply_to"), F.col("message_id")
        ).alias("references"),
        normalise_body(F.col("reply")).alias("body"),
        "thread_id",
    )


def mark_read(labels: Column) -> Column:
    return F.array_remove(labels, "UNREAD")


def add_label(labels: Column, label: str = "NEEDS_REVIEW") -> Column:
    return F.array_union(labels, F.array(F.lit(label)))


def latest_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Newest row per key; the rank filter is applied per map task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
