"""Run reports over the event table taken as finished runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskspark.operators import reports as J
from deskspark.registry import register
from deskspark.registry.views import any_contains, drafts, table, with_ctes
from deskspark.rules import ESCALATION_TERMS

RUNS_SQL = """WITH runs AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, ts, value AS total_time, value * 0.25 AS retrieval_time, value * 0.5 AS generation_time,
    k / 10.0 AS qa_score, k >= 70 AS qa_approved, k % 4 = 0 AS used_cache, CAST(event_id % 3 AS INTEGER) AS revision_count,
    CASE event_type WHEN 'purchase' THEN 'completed_approved' WHEN 'signup' THEN 'completed_approved'
      WHEN 'click' THEN 'requires_manual_review' WHEN 'view' THEN 'completed_skipped'
      WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'error' ELSE 'processing' END END AS status,
    event_type = 'signup' AS feedback_saved, event_type = 'purchase' AND k % 10 <> 3 AS email_sent,
    CASE WHEN k % 9 = 0 THEN '' WHEN k % 5 = 0 THEN 'A specialist will help' ELSE 'Answer ' || k END AS final_response,
    'Draft ' || k AS draft_response, k % 6 = 0 AS response_redacted
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""


def runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    return e.select(
        "event_id", F.col("event_id").cast("string").alias("id"), "ts", F.col("value").alias("total_time"),
        (F.col("value") * 0.25).alias("retrieval_time"), (F.col("value") * 0.5).alias("generation_time"),
        (k / F.lit(10.0)).alias("qa_score"), (k >= 70).alias("qa_approved"), (k % 4 == 0).alias("used_cache"),
        (F.col("event_id") % 3).cast("int").alias("revision_count"),
        F.when(kind.isin("purchase", "signup"), F.lit("completed_approved"))
        .when(kind == "click", F.lit("requires_manual_review")).when(kind == "view", F.lit("completed_skipped"))
        .when(kind == "error", F.when(k % 2 == 0, F.lit("error")).otherwise(F.lit("processing"))).alias("status"),
        (kind == "signup").alias("feedback_saved"), ((kind == "purchase") & (k % 10 != 3)).alias("email_sent"),
        F.when(k % 9 == 0, F.lit("")).when(k % 5 == 0, F.lit("A specialist will help"))
        .otherwise(F.concat(F.lit("Answer "), k)).alias("final_response"),
        F.concat(F.lit("Draft "), k).alias("draft_response"), (k % 6 == 0).alias("response_redacted"),
    )


AVERAGES = ("avg_total_time", "avg_retrieval_time", "avg_generation_time", "avg_qa_score",
            "approval_rate", "cache_hit_rate", "avg_revisions")


@register("run_summary", RUNS_SQL + """
SELECT count(*) AS total_mails, round(avg(total_time), 6) AS avg_total_time, round(avg(retrieval_time), 6) AS avg_retrieval_time,
  round(avg(generation_time), 6) AS avg_generation_time, round(avg(qa_score), 6) AS avg_qa_score,
  round(avg(CAST(qa_approved AS INTEGER)), 6) AS approval_rate, round(avg(CAST(used_cache AS INTEGER)), 6) AS cache_hit_rate,
  round(avg(revision_count), 6) AS avg_revisions,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS session_seconds
FROM runs HAVING count(*) > 0""")
def run_summary(spark, sf_dir):
    s = J.run_summary(runs(spark, sf_dir), "ts")
    return s.select("total_mails", *[F.round(c, 6).alias(c) for c in AVERAGES], "session_seconds")


@register("summary_text", RUNS_SQL + """
SELECT CAST(count(*) AS VARCHAR) AS total_mails, printf('%.2fs', avg(total_time)) AS avg_total_time,
  printf('%.1f/10', avg(qa_score)) AS avg_qa_score, printf('%.1f%%', avg(CAST(qa_approved AS INTEGER)) * 100) AS approval_rate,
  printf('%.1f%%', avg(CAST(used_cache AS INTEGER)) * 100) AS cache_hit_rate, printf('%.2f', avg(revision_count)) AS avg_revisions
FROM runs""")
def summary_text(spark, sf_dir):
    return J.formatted_summary(J.run_summary(runs(spark, sf_dir)))


@register("status_breakdown", RUNS_SQL + "SELECT status, count(*) AS runs FROM runs GROUP BY status")
def status_breakdown(spark, sf_dir):
    return J.status_breakdown(runs(spark, sf_dir))


@register("outcome_tally", RUNS_SQL + """
, o AS (SELECT CASE WHEN email_sent THEN 'sent' WHEN feedback_saved THEN 'feedback_saved'
    WHEN status = 'requires_manual_review' THEN 'manual_review' WHEN status = 'completed_skipped' THEN 'skipped'
    WHEN status = 'error' THEN 'errors' END AS o FROM runs)
SELECT count(*) AS total, count(*) FILTER (WHERE o = 'sent') AS sent, count(*) FILTER (WHERE o = 'feedback_saved') AS feedback_saved,
  count(*) FILTER (WHERE o = 'manual_review') AS manual_review, count(*) FILTER (WHERE o = 'skipped') AS skipped,
  count(*) FILTER (WHERE o = 'errors') AS errors FROM o""")
def outcome_tally(spark, sf_dir):
    return J.outcome_tally(runs(spark, sf_dir))


@register("action_decision", RUNS_SQL + f"""
, d AS (SELECT id, status, feedback_saved, status = 'completed_approved' AND final_response <> '' AS approved,
    {any_contains('lower(final_response)', ESCALATION_TERMS)} AS esc FROM runs),
a AS (SELECT *, CASE WHEN status = 'completed_skipped' THEN 'mark_read' WHEN status = 'error' THEN 'none'
    WHEN status = 'requires_manual_review' THEN 'add_label' WHEN approved AND esc THEN 'add_label'
    WHEN approved THEN 'mark_read' ELSE 'none' END AS action FROM d)
SELECT id, status, action, CASE WHEN action = 'add_label' THEN 'NEEDS_REVIEW' END AS label,
  approved AND NOT feedback_saved AS email_sent FROM a""")
def action_decision(spark, sf_dir):
    out = J.decide_action(runs(spark, sf_dir).drop("email_sent"))
    return out.select("id", "status", "action", "label", "email_sent")


@register("report_rows", RUNS_SQL + """
SELECT id, coalesce(nullif(final_response, ''), draft_response) AS response,
  CASE WHEN response_redacted THEN 'Personal data was removed' END AS note,
  CASE WHEN status = 'completed_approved' AND feedback_saved THEN 'Feedback logged, nothing sent'
    WHEN status = 'completed_approved' THEN 'Reply sent' WHEN status = 'requires_manual_review' THEN 'Flagged for review, nothing sent'
    WHEN status = 'completed_skipped' THEN 'Skipped, no automated reply' WHEN status = 'error' THEN 'Error, nothing sent'
    ELSE status END AS action FROM runs""")
def report_rows(spark, sf_dir):
    return J.report_rows(runs(spark, sf_dir))


@register("final_status", RUNS_SQL + """
SELECT id, CASE WHEN used_cache THEN 'completed_skipped' WHEN feedback_saved THEN 'completed_approved'
  WHEN qa_approved THEN 'completed_approved' ELSE 'requires_manual_review' END AS final_status FROM runs""")
def final_status(spark, sf_dir):
    route = F.when(F.col("used_cache"), F.lit("skip")).when(F.col("feedback_saved"), F.lit("feedback")).otherwise(F.lit("process"))
    return runs(spark, sf_dir).select("id", J.final_status(route, F.col("qa_approved")).alias("final_status"))


@register("revision_pick", with_ctes("drafts") + """
, a AS (SELECT CAST(conv_id AS VARCHAR) AS id, CAST(turn AS BIGINT) AS attempt, reply AS draft, len(text) % 3 = 0 AS approved FROM drafts WHERE turn <= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY approved DESC, CASE WHEN approved THEN attempt ELSE -attempt END) AS rn FROM a)
SELECT id, attempt, draft, CASE WHEN approved THEN 'completed_approved' ELSE 'requires_manual_review' END AS status FROM p WHERE rn = 1""")
def revision_pick(spark, sf_dir):
    """Turns of a conversation as successive attempts of one reply."""
    attempts = drafts(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("attempt"), F.col("reply").alias("draft"),
        (F.length("text") % 3 == 0).alias("approved"),
    )
    return J.pick_revision(attempts)


@register("error_rows", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS raw, user_id FROM events),
c AS (SELECT event_id, CASE WHEN TRY_CAST(raw AS DOUBLE) IS NULL THEN 'unreadable amount' WHEN TRY_CAST(raw AS DOUBLE) > 60 THEN 'amount too large' END AS error_message FROM e)
SELECT event_id, error_message, CASE WHEN error_message IS NOT NULL THEN 'error' ELSE 'processing' END AS status FROM c""")
def error_rows(spark, sf_dir):
    raw = F.when(F.col("event_id") % 6 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    e = table(spark, sf_dir, "events").withColumn("amount", raw.try_cast("double"))
    out = J.isolate_errors(e, {"unreadable amount": F.col("amount").isNotNull(), "amount too large": F.col("amount") <= 60})
    return out.select("event_id", "error_message", "status")
