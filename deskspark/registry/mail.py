"""Mail intake, threading and outgoing-mail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskspark.functions import text as X
from deskspark.operators import mail as M
from deskspark.registry import register
from deskspark.registry.views import mails, msgs, sql_strip, table, with_ctes

# Labels and tabs of the derived inbox.
INBOX_SQL = with_ctes("mails") + """, inbox AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN ['INBOX'] ELSE ['INBOX', 'UNREAD'] END AS labels,
    CASE lang WHEN 'de' THEN ['promotions'] WHEN 'es' THEN ['social', 'news'] ELSE ['primary'] END AS tabs
  FROM mails)
"""


def inbox(spark, sf_dir):
    labels = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("INBOX"))).otherwise(
        F.array(F.lit("INBOX"), F.lit("UNREAD"))
    )
    tabs = (
        F.when(F.col("lang") == "de", F.array(F.lit("promotions")))
        .when(F.col("lang") == "es", F.array(F.lit("social"), F.lit("news")))
        .otherwise(F.array(F.lit("primary")))
    )
    return mails(spark, sf_dir).withColumns({"labels": labels, "tabs": tabs})


def seen(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))


@register("scan_unread", INBOX_SQL + """
SELECT id, sender, subject, received_at FROM inbox
WHERE list_contains(labels, 'UNREAD') AND list_contains(labels, 'INBOX')
  AND NOT EXISTS (SELECT 1 FROM labels s WHERE CAST(s.doc_id AS VARCHAR) = inbox.id)""")
def scan_unread(spark, sf_dir):
    out = M.scan_unread(inbox(spark, sf_dir), seen(spark, sf_dir))
    return out.select("id", "sender", "subject", "received_at")


@register("scan_support", INBOX_SQL + """
SELECT id, sender_raw AS sender, subject, received_at FROM inbox
WHERE list_contains(labels, 'UNREAD') AND list_contains(labels, 'INBOX')
  AND NOT list_has_any(tabs, ['promotions', 'social', 'forums'])
  AND NOT regexp_matches(lower(sender_raw), 'noreply|no-reply|donotreply|automated')
  AND NOT EXISTS (SELECT 1 FROM labels s WHERE CAST(s.doc_id AS VARCHAR) = inbox.id)""")
def scan_support(spark, sf_dir):
    box = inbox(spark, sf_dir).withColumn("sender", F.col("sender_raw"))
    return M.scan_support(box, seen(spark, sf_dir)).select("id", "sender", "subject", "received_at")


@register("drop_automated", with_ctes("mails") + """
SELECT id, sender_raw FROM mails
WHERE NOT regexp_matches(lower(sender_raw), 'noreply|no-reply|donotreply|automated')""")
def drop_automated(spark, sf_dir):
    return M.drop_automated(mails(spark, sf_dir), "sender_raw").select("id", "sender_raw")


@register("dedup_ids", """
SELECT CAST(user_id AS VARCHAR) AS id, min(event_id) AS event_id,
  arg_min(event_type, event_id) AS event_type
FROM events GROUP BY user_id""")
def dedup_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), "event_id", "event_type"
    )
    return M.dedup_ids(e, "id", "event_id")


@register("header_lookup", with_ctes("mails") + """
SELECT id, subject AS subject_header, sender_raw AS from_header, CAST(NULL AS VARCHAR) AS cc_header
FROM mails""")
def header_lookup(spark, sf_dir):
    def header(name, value):
        return F.struct(F.lit(name).alias("name"), F.col(value).alias("value"))

    heads = F.array(header("SUBJECT", "subject"), header("From", "sender_raw"),
                    header("subject", "lang"))
    m = mails(spark, sf_dir).withColumn("headers", heads)
    return m.select(
        "id",
        M.header_value(F.col("headers"), "Subject").alias("subject_header"),
        M.header_value(F.col("headers"), "from").alias("from_header"),
        M.header_value(F.col("headers"), "Cc").alias("cc_header"),
    )


@register("sender_extract", with_ctes("mails") + r"""
SELECT id, sender_raw,
  coalesce(nullif(regexp_extract(sender_raw, '<(.+?)>', 1), ''),
           nullif(regexp_extract(sender_raw, '[\w.-]+@[\w.-]+\.\w+', 0), ''), sender_raw) AS sender
FROM mails""")
def sender_extract(spark, sf_dir):
    m = mails(spark, sf_dir)
    return m.select("id", "sender_raw", M.sender_address(F.col("sender_raw")).alias("sender"))


@register("mail_date", """
WITH e AS (SELECT event_id, ts, event_id % 7 = 0 AS bad FROM events)
SELECT event_id, CASE WHEN bad THEN TIMESTAMP '2024-02-01 00:00:00'
  ELSE date_trunc('second', ts) - INTERVAL 2 HOUR END AS received_at FROM e""")
def mail_date(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("not a date")).otherwise(
        F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    )
    as_of = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    return e.select(
        "event_id", M.parse_mail_date(raw, as_of).cast("timestamp_ntz").alias("received_at")
    )


@register("body_select", r"""
WITH parts AS (
  SELECT conv_id, turn, role, text, conv_id % 5 AS kind FROM conversations),
plain AS (SELECT conv_id, arg_max(text, turn) AS plain FROM parts
          WHERE kind <> 0 AND role = 'user' AND text <> '' GROUP BY conv_id),
html AS (SELECT conv_id, arg_max(text, turn) AS html FROM parts
         WHERE role = 'assistant' AND text <> '' GROUP BY conv_id)
SELECT CAST(c.conv_id AS VARCHAR) AS message_id,
  coalesce(nullif(p.plain, ''),
    CASE WHEN h.html <> '' THEN """ + sql_strip(
    r"""regexp_replace(regexp_replace(h.html, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g')"""
) + r""" END, 'No body content') AS body
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN plain p USING (conv_id) LEFT JOIN html h USING (conv_id)""")
def body_select(spark, sf_dir):
    """Turns as MIME parts: user turns plain, assistant turns HTML, each base64url-coded."""
    c = table(spark, sf_dir, "conversations")
    mime = (
        F.when((F.col("role") == "user") & (F.col("conv_id") % 5 != 0), F.lit("text/plain"))
        .when(F.col("role") == "assistant", F.lit("text/html"))
        .otherwise(F.lit("application/pdf"))
    )
    page = F.when(F.col("role") == "assistant", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))
    data = F.translate(
        F.base64(F.coalesce(page, F.col("text")).cast("binary")), "+/", "-_"
    )
    return M.select_body(c.select(
        F.col("conv_id").cast("string").alias("message_id"), F.col("turn").alias("part_no"),
        mime.alias("mime_type"), data.alias("data"),
    ))


def _html_sql() -> str:
    markup = (r"(?is)<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>|<!--.*?-->|<[^>]*>")
    expr = f"regexp_replace(html, '{markup}', '\\1\\2', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"),
                         ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    expr = rf"regexp_replace({expr}, '\n\s*\n', chr(10) || chr(10), 'g')"
    return f"SELECT page_id, {sql_strip(f'regexp_replace({expr}, {chr(39)} +{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} AS text FROM pages"


@register("html_text", _html_sql())
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@register("row_json", with_ctes("mails") + """
SELECT id, CAST(json_object('id', id, 'sender', sender, 'subject', subject, 'body', body,
  'received_at', strftime(received_at, '%Y-%m-%dT%H:%M:%S')) AS VARCHAR) AS json FROM mails""")
def row_json(spark, sf_dir):
    m = mails(spark, sf_dir)
    return m.select("id", M.row_json("received_at", "id", "sender", "subject", "body").alias("json"))


@register("reply_subject", with_ctes("mails") + """
, s AS (SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'RE: ' || subject ELSE subject END AS subject,
          CASE WHEN doc_id % 10 = 1 THEN 'Ticket ' || id END AS given FROM mails)
SELECT id, coalesce(given, CASE WHEN starts_with(lower(subject), 're:') THEN subject
  ELSE 'Re: ' || subject END) AS reply_subject FROM s""")
def reply_subject(spark, sf_dir):
    m = mails(spark, sf_dir)
    subject = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("RE: "), F.col("subject"))).otherwise(
        F.col("subject")
    )
    given = F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("Ticket "), F.col("id")))
    return m.select("id", M.reply_subject(subject, given).alias("reply_subject"))


NORM_SQL = "CASE WHEN {0} = '' THEN '' ELSE '<' || trim(trim({0}), '<>') || '>' END"


@register("msgid_norm", with_ctes("msgs") + f"""
SELECT id, {NORM_SQL.format('raw_id')} AS message_id FROM msgs""")
def msgid_norm(spark, sf_dir):
    return msgs(spark, sf_dir).select(
        "id", M.normalise_message_id(F.col("raw_id")).alias("message_id")
    )


@register("thread_refs", with_ctes("msgs") + f"""
, n AS (SELECT id, list({NORM_SQL.format('raw_id')}) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain FROM msgs)
SELECT id, array_to_string(chain, ' ') AS refs FROM n""")
def thread_refs(spark, sf_dir):
    m = msgs(spark, sf_dir).withColumnRenamed("turn", "position")
    out = M.thread_references(m, F.col("raw_id"))
    return out.select("id", F.col("references").alias("refs"))


BODY_NORM_SQL = sql_strip(
    r"""regexp_replace(regexp_replace({0}, '(^|\n)[ \t\x{{00A0}}]+', '\1', 'g'), '[ \t]+(\n|$)', '\1', 'g')"""
)


@register("body_norm", with_ctes("mails") + r"""
, s AS (SELECT id, replace(body, '. ', '.  ' || chr(10) || chr(10) || '  ' || chr(10) || chr(9)) AS body FROM mails)
SELECT id, regexp_replace(""" + BODY_NORM_SQL.format("body") + r""", '\n{3,}', chr(10) || chr(10), 'g') AS body
FROM s""")
def body_norm(spark, sf_dir):
    spread = F.replace(F.col("body"), F.lit(". "), F.lit(".  \n\n  \n\t"))
    return mails(spark, sf_dir).select("id", M.normalise_body(spread).alias("body"))


@register("outbox", with_ctes("mails", "msgs") + f"""
, r AS (SELECT id, {NORM_SQL.format('raw_id')} AS mid, text, conv_id, turn,
    list({NORM_SQL.format('raw_id')}) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain FROM msgs)
SELECT r.id, 'user' || r.turn || '@mail.example.com' AS to_address,
  'Re: Case ' || r.conv_id AS subject, mid AS in_reply_to,
  array_to_string(chain, ' ') AS refs,
  regexp_replace({BODY_NORM_SQL.format('r.text')}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS body,
  CAST(conv_id AS VARCHAR) AS thread_id
FROM r""")
def outbox(spark, sf_dir):
    m = msgs(spark, sf_dir)
    threaded = M.thread_references(m.withColumn("position", F.col("turn")), F.col("raw_id"))
    replies = threaded.select(
        "id",
        F.concat(F.lit("User <user"), F.col("turn"), F.lit("@mail.example.com>")).alias("sender"),
        F.concat(F.lit("Case "), F.col("conv_id")).alias("subject"),
        "message_id", "references", "in_reply_to", F.col("text").alias("reply"), "thread_id",
    )
    return M.outbox(replies).withColumnRenamed("references", "refs")


@register("label_update", INBOX_SQL + """
SELECT id, array_to_string(list_filter(labels, lambda l: l <> 'UNREAD'), ',') AS read_labels,
  array_to_string(list_append(labels, 'NEEDS_REVIEW'), ',') AS review_labels FROM inbox""")
def label_update(spark, sf_dir):
    return inbox(spark, sf_dir).select(
        "id",
        F.array_join(M.mark_read(F.col("labels")), ",").alias("read_labels"),
        F.array_join(M.add_label(F.col("labels")), ",").alias("review_labels"),
    )
