"""Streaming queries, drained once over the event table so they can be checked against a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskspark import schemas
from deskspark.registry import ORACLES, register
from deskspark.registry import accounts as _accounts  # noqa: F401  the batch form of the lookup is there
from deskspark.session import shared_dir
from deskspark.sources.mail import stream_table
from deskspark.streaming import keyed_state as K
from deskspark.streaming import mail_stream as S

STATUS_SQL = """CASE event_type WHEN 'purchase' THEN 'completed_approved' WHEN 'signup' THEN 'completed_approved'
  WHEN 'click' THEN 'requires_manual_review' WHEN 'view' THEN 'completed_skipped' ELSE 'error' END"""


def events(spark, sf_dir):
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("purchase", "signup"), F.lit("completed_approved")).when(kind == "click", F.lit("requires_manual_review"))
        .when(kind == "view", F.lit("completed_skipped")).otherwise(F.lit("error")))
    return stream_table(spark, f"{sf_dir}/events.parquet", schemas.EVENTS).withColumn("status", status)


@register("stream_drain", f"SELECT event_id, user_id, {STATUS_SQL} AS status, value FROM events")
def stream_drain(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "status", "value")
    root = shared_dir(spark)
    S.drain(rows, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


@register("stream_status", f"SELECT {STATUS_SQL} AS status, count(*) AS runs FROM events GROUP BY 1")
def stream_status(spark, sf_dir):
    counts = S.running_counts(events(spark, sf_dir), "status")
    root = shared_dir(spark)
    S.drain_table(counts, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(counts.schema).parquet(f"{root}/out")


@register("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    once = S.dedup_stream(events(spark, sf_dir), "user_id", "ts", "60 days").select("user_id")
    root = shared_dir(spark)
    S.drain(once, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(once.schema).parquet(f"{root}/out")


@register("stream_snapshots", ORACLES["snapshot_ttl"])
def stream_snapshots(spark, sf_dir):
    """The snapshot lookup with views as entries of the state and all other events as questions."""
    e = stream_table(spark, f"{sf_dir}/events.parquet", schemas.EVENTS)
    view, own = F.col("event_type") == "view", F.col("event_id").cast("string")
    rows = e.select(F.col("user_id").cast("string").alias("key"), "ts", F.when(~view, own).alias("id"), F.when(view, own).alias("value"))
    root = shared_dir(spark)
    K.drain(K.as_of(rows, 21600, "1 day"), f"{root}/out", f"{root}/checkpoint")
    answers = spark.read.schema("id string, at timestamp_ntz, value string").parquet(f"{root}/out")
    return answers.select("id", F.col("at").alias("cached_at"), F.col("value").alias("snapshot_id"))
