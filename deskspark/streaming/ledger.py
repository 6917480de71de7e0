"""Stream batches whose outputs count once: a ledger of finished batches over plain table folders.

Spark may hand the same micro-batch to its handler again after a failure. Each output of a batch goes to a folder
of its own, which a second try replaces, and the batch enters the ledger when all of its outputs are there.
Readers see finished batches only, so a batch is visible with all of its outputs or with none, and a batch
that is handed over again after it was finished writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Write = Callable[[str, DataFrame], DataFrame]
LEDGER = "ledger"


def finished(spark: SparkSession, root: str) -> DataFrame:
    """(batch): the batches of the ledger."""
    schema = "batch long"
    try:
        return spark.read.schema(schema).parquet(f"{root}/{LEDGER}")
    except AnalysisException:  # no batch has been finished yet
        return spark.createDataFrame([], schema)


def once_per_batch(root: str, work: Callable[[DataFrame, Write], None]) -> Callable[[DataFrame, int], None]:
    """Batch handler around `work(batch, write)`; `write(name, rows)` stores an output and returns it as stored."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not finished(spark, root).where(F.col("batch") == batch_id).isEmpty():
            return

        def write(name: str, rows: DataFrame) -> DataFrame:
            path = f"{root}/{name}/batch={batch_id}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        work(batch, write)
        entry = spark.range(1).select(F.lit(batch_id).cast("long").alias("number"))
        entry.write.mode("overwrite").parquet(f"{root}/{LEDGER}/batch={batch_id}")

    return handle


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of one output from finished batches, with their batch."""
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return rows.withColumn("batch", F.col("batch").cast("long")).join(finished(spark, root), "batch", "left_semi")


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand over everything that is there, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
