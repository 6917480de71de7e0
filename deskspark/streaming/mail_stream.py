"""Structured Streaming jobs: polling, draining, dedup, running counts, cache log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deskspark.operators import cache as I
from deskspark.settings import DEFAULTS, Settings


def dedup_stream(stream: DataFrame, id_column: str, ts_column: str, horizon: str) -> DataFrame:
    """One row per id within the horizon; the watermark lets old ids leave the state."""
    stamped = stream.withColumn(ts_column, F.col(ts_column).cast("timestamp"))
    return stamped.withWatermark(ts_column, horizon).dropDuplicatesWithinWatermark([id_column])


def running_counts(stream: DataFrame, column: str) -> DataFrame:
    return stream.groupBy(column).agg(F.count("*").alias("runs"))


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that is there once and stop: append rows to a parquet folder."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(out)
    )
    query.awaitTermination()


def drain_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain an aggregate; the table holds the latest complete result."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)
        .outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def poll(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
    settings: Settings = DEFAULTS,
) -> StreamingQuery:
    """Continuous mode: hand each poll's rows to `handle` until the query is stopped."""
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{settings.poll_seconds} seconds").start()
    )


def append_batch(path: str, day: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Batch handler that appends rows under (batch, day); a repeated batch replaces itself."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id))
        keys = ["batch"]
        if day is not None:
            rows = rows.withColumn("day", day)
            keys.append("day")
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*keys).parquet(path))

    return handle


def cache_log_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Cache rows go to an append-only log by day, never rewriting what is stored."""
    return append_batch(path, F.to_date("ts"))


def read_cache_log(spark: SparkSession, path: str, as_of: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Live cache of a log: days past the lifetime are pruned before the read, last write wins."""
    now = F.lit(as_of).cast("timestamp_ntz")
    oldest = F.to_date(now - F.make_dt_interval(hours=F.lit(settings.ttl_hours)))
    log = spark.read.parquet(path).filter(F.col("day") >= oldest).drop("batch", "day")
    return I.unexpired(I.upsert(log.limit(0), log), now, settings)
