"""Table sinks: append, overwrite, insert-if-absent, logs and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows plus the new rows whose key is not stored yet."""
    fresh = new.join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def append_feedback(lines: DataFrame, path: str) -> None:
    """One text log per category; rows are (category, line)."""
    lines.select("category", "line").write.mode("append").partitionBy("category").text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk and vector table, one folder per knowledge category."""
    chunks.write.mode("overwrite").partitionBy("category").parquet(path)


def write_keyword_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings split by a hash bucket of the term, so a term lookup reads one folder."""
    from pyspark.sql import functions as F

    bucketed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    bucketed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(target)


def drop_table(spark: SparkSession, path: str) -> bool:
    """Delete a stored index; False when there was none."""
    if not table_exists(spark, path):
        return False
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
