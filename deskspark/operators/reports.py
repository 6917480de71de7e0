"""Run metrics, outcome tallies, action decisions and the status ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.operators.classify import has_escalation
from deskspark.settings import DEFAULTS, Settings


def _rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))


def run_summary(metrics: DataFrame, started: str | None = None) -> DataFrame:
    """One row of run averages and rates; no input rows give no output row."""
    session = []
    if started is not None:
        seconds = F.unix_micros(F.max(started).cast("timestamp")) - F.unix_micros(
            F.min(started).cast("timestamp"))
        session = [(seconds / 1_000_000).alias("session_seconds")]
    return metrics.agg(
        F.count("*").alias("total_mails"),
        F.avg("total_time").alias("avg_total_time"),
        F.avg("retrieval_time").alias("avg_retrieval_time"),
        F.avg("generation_time").alias("avg_generation_time"),
        F.avg("qa_score").alias("avg_qa_score"),
        _rate("qa_approved").alias("approval_rate"),
        _rate("used_cache").alias("cache_hit_rate"),
        F.avg("revision_count").alias("avg_revisions"),
        *session,
    ).filter("total_mails > 0")


def formatted_summary(summary: DataFrame) -> DataFrame:
    """Rounded texts of the summary row."""
    def fixed(name: str, pattern: str, scale: float = 1.0) -> Column:
        return F.format_string(pattern, F.col(name) * scale).alias(name)

    return summary.select(
        F.col("total_mails").cast("string").alias("total_mails"),
        fixed("avg_total_time", "%.2fs"),
        fixed("avg_qa_score", "%.1f/10"),
        fixed("approval_rate", "%.1f%%", 100.0),
        fixed("cache_hit_rate", "%.1f%%", 100.0),
        fixed("avg_revisions", "%.2f"),
    )


def status_breakdown(runs: DataFrame, column: str = "status") -> DataFrame:
    return runs.groupBy(column).agg(F.count("*").alias("runs"))


def outcome() -> Column:
    """First matching outcome of a finished mail; NULL when none matches."""
    return (
        F.when(F.col("email_sent"), F.lit("sent"))
        .when(F.col("feedback_saved"), F.lit("feedback_saved"))
        .when(F.col("status") == "requires_manual_review", F.lit("manual_review"))
        .when(F.col("status") == "completed_skipped", F.lit("skipped"))
        .when(F.col("status") == "error", F.lit("errors"))
    )


def outcome_tally(results: DataFrame) -> DataFrame:
    o = results.withColumn("_o", outcome())
    names = ("sent", "feedback_saved", "manual_review", "skipped", "errors")
    return o.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("_o") == n).alias(n) for n in names]
    )


def decide_action(results: DataFrame) -> DataFrame:
    """Mail-box action, label and whether the reply goes out."""
    escalates = has_escalation(F.col("final_response"))
    approved = (F.col("status") == "completed_approved") & (
        F.coalesce(F.col("final_response"), F.lit("")) != ""
    )
    action = (
        F.when(F.col("status") == "completed_skipped", F.lit("mark_read"))
        .when(F.col("status") == "error", F.lit("none"))
        .when(F.col("status") == "requires_manual_review", F.lit("add_label"))
        .when(approved & escalates, F.lit("add_label"))
        .when(approved, F.lit("mark_read"))
        .otherwise(F.lit("none"))
    )
    return results.withColumns({
        "action": action,
        "label": F.when(action == "add_label", F.lit("NEEDS_REVIEW")),
        "email_sent": F.coalesce(approved & ~F.col("feedback_saved"), F.lit(False)),
    })


def report_rows(results: DataFrame) -> DataFrame:
    """Printable outcome of each mail."""
    action = (
        F.when((F.col("status") == "completed_approved") & F.col("feedback_saved"),
               F.lit("Feedback logged, nothing sent"))
        .when(F.col("status") == "completed_approved", F.lit("Reply sent"))
        .when(F.col("status") == "requires_manual_review", F.lit("Flagged for review, nothing sent"))
        .when(F.col("status") == "completed_skipped", F.lit("Skipped, no automated reply"))
        .when(F.col("status") == "error", F.lit("Error, nothing sent"))
        .otherwise(F.col("status"))
    )
    return results.select(
        "id",
        F.coalesce(F.nullif("final_response", F.lit("")), "draft_response").alias("response"),
        F.when(F.col("response_redacted"), F.lit("Personal data was removed")).alias("note"),
        action.alias("action"),
    )


def final_status(route: Column, approved: Column) -> Column:
    return (
        F.when(route == "skip", F.lit("completed_skipped"))
        .when(route == "feedback", F.lit("completed_approved"))
        .when(F.coalesce(approved, F.lit(False)), F.lit("completed_approved"))
        .otherwise(F.lit("requires_manual_review"))
    )


def pick_revision(attempts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """First approved attempt within the allowed revisions, else the last one tried.

    Works as two partial aggregates, so any number of attempts per mail is combined map-side.
    """
    allowed = attempts.filter(F.col("attempt") <= settings.max_revisions)
    row = F.struct("attempt", "draft", "approved")
    ok = F.col("approved")
    picked = allowed.groupBy("id").agg(
        F.min_by(F.when(ok, row), F.when(ok, F.col("attempt"))).alias("good"),
        F.max_by(row, F.col("attempt")).alias("last"),
    )
    best = F.coalesce("good", "last")
    return picked.select(
        "id", best["attempt"].alias("attempt"), best["draft"].alias("draft"),
        F.when(best["approved"], F.lit("completed_approved"))
        .otherwise(F.lit("requires_manual_review")).alias("status"),
    )


def isolate_errors(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Mark rows that break a check with status error and the check's name; others go on."""
    first = F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    )
    return rows.withColumn("error_message", first).withColumn(
        "status", F.when(F.col("error_message").isNotNull(), F.lit("error")).otherwise(F.lit("processing"))
    )
