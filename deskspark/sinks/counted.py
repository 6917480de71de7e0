"""Writes that count what passes: row counts come with the write itself, not from a second pass over the data.

The counts are observed on the rows of the stage that writes, so a task that is tried again counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from deskspark.operators import cache as I
from deskspark.settings import DEFAULTS, Settings


def write_counted(rows: DataFrame, path: str, keep: Column, mode: str = "errorifexists", **counts: Column) -> dict[str, int]:
    """Write the rows that `keep` holds for; returns before, after, removed and the aggregates of `counts` over all rows."""
    seen = Observation()
    flag = F.coalesce(keep, F.lit(False))
    watched = rows.withColumn("__keep", flag).observe(
        seen, F.count("*").alias("before"), F.count_if("__keep").alias("after"), *[c.alias(n) for n, c in counts.items()])
    watched.where("__keep").drop("__keep").write.mode(mode).parquet(path)
    got = seen.get
    return got | {"removed": got["before"] - got["after"]}


def purge(cache: DataFrame, as_of: Column, path: str, settings: Settings = DEFAULTS) -> dict[str, int]:
    """Write the live entries of a cache to a new place, with the numbers of entries before and after."""
    return write_counted(cache, path, ~I.expired(F.col("ts"), as_of, settings), oldest=F.min("ts"), newest=F.max("ts"))
