"""Mail sources: JSON folders, mailbox exports, streaming folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from deskspark import schemas
from deskspark.functions import text as X
from deskspark.operators import mail as M
from deskspark.session import materialise


def read_json_mails(spark: SparkSession, folder: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """All *.json files of a folder as mails, plus the rejected files.

    A missing id becomes email_NNN by the file's place in name order among the accepted ones. A file
    without sender, subject or body is rejected.
    """
    raw = (
        spark.read.schema(schemas.EMAIL_JSON).option("multiLine", True)
        .option("pathGlobFilter", "*.json").json(folder)
        .withColumn("file", F.col("_metadata.file_name"))
    )
    required = F.col("sender").isNotNull() & F.col("subject").isNotNull() & F.col("body").isNotNull()
    good, rejects = raw.filter(required), raw.filter(~required | required.isNull())
    places = numbered(good.select("file"), "file").select("file", F.format_string("email_%03d", "place").alias("auto_id"))
    mails = good.join(places, "file").select(
        F.coalesce(X.blank_to_null(F.col("id")), "auto_id").alias("id"), "sender", "subject", "body",
        F.lit(as_of).cast("timestamp_ntz").alias("received_at"), F.lit(None).cast("string").alias("thread_id"),
    )
    return mails, rejects.select("file", "id", "sender", "subject", "body")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Add `place`, the row's number in the order of a unique column.

    Rows are cut into ranges, numbered inside each, and shifted by the sizes of the ranges before; only
    those sizes, one per range, are ever seen together.
    """
    ranges = materialise(
        df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_range", before.alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(order))
    joined = ranges.withColumn("_within", within).join(F.broadcast(shifts), "_range")
    return joined.withColumn("place", F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")


def mailbox_mails(messages: DataFrame, parts: DataFrame, as_of: str) -> DataFrame:
    """Exported mailbox messages (id, thread_id, headers, labels, tabs) and their parts as mails."""
    heads = F.col("headers")
    bodies = M.select_body(parts).withColumnRenamed("message_id", "id")
    sender = M.sender_address(F.coalesce(M.header_value(heads, "From"), F.lit("Unknown")))
    as_of_col = F.to_timestamp(F.lit(as_of))
    return messages.join(bodies, "id", "left").select(
        "id", sender.alias("sender"),
        F.coalesce(X.blank_to_null(M.header_value(heads, "Subject")), F.lit("No Subject")).alias("subject"),
        F.coalesce("body", F.lit("No body content")).alias("body"),
        M.parse_mail_date(M.header_value(heads, "Date"), as_of_col).cast("timestamp_ntz").alias("received_at"),
        F.coalesce("thread_id", "id").alias("thread_id"), "headers", "labels", "tabs",
    )


def stream_json_mails(spark: SparkSession, folder: str, files_per_poll: int = 10) -> DataFrame:
    """Streaming form of the folder scan; the rate cap is the number of mails per poll."""
    return (
        spark.readStream.schema(schemas.EMAIL_JSON).option("multiLine", True)
        .option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_poll).json(folder)
        .dropna(subset=["sender", "subject", "body"])
    )


def stream_parquet(
    spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_poll: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_poll:
        reader = reader.option("maxFilesPerTrigger", files_per_poll)
    return reader.parquet(folder)


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table as a stream, be it one file or a folder of files.

    Spark takes only a folder or a pattern as a stream's place, so the path is given as a pattern of itself.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
