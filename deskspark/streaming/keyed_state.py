"""Keyed state with a lifetime: account snapshots and replies that a mail stream looks up as of its own time.

A stream of entries (key, at, value) and questions (key, at, id) runs through one stateful operator. A question gets the newest entry of
its key that is not after it and not older than the lifetime, as in the batch `fresh_snapshots`. Entries
count from the micro-batch they arrive in; within one, rows are taken in order of their time, whatever the order of arrival.

Time is cut into buckets of SPAN lifetimes, and the state is kept by (shard, bucket), where a shard is the keys of one of SHARDS hashes, as a
call for every key and bucket would cost more than its few rows: an entry goes to its own bucket and, from the last
lifetime of it, to the next as well, so a question needs its own bucket only. A key with a third of all rows is thus spread over its buckets, and the state of a bucket
has an end: a timer removes it when the watermark passes. Of a key in a bucket, all entries of one time but the largest value are dropped, so
nothing is kept that no question could get.

Rows of a null key or time are never an answer and never get one. State and timers live in the checkpoint (RocksDB); a
restarted query goes on where it stopped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
SPAN = 4
SHARDS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AsOf(StatefulProcessor):
    """State of one (shard, bucket): its entries as (key, microsecond, value) in order of key and time."""

    def __init__(self, lifetime: int):
        self.lifetime, self.span = lifetime * 1_000_000, lifetime * 1000 * SPAN

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "key string, at long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        held = {(r[0], r[1]): r[2] for r in self.entries.get()}
        known, new = len(held), got[got["id"].isna()]
        for at, value in zip(zip(new["key"], new["us"]), new["value"]):
            if at not in held or held[at] < value:
                held[at] = value
        if len(new):
            if not known:
                self.handle.registerTimer(int((key[1] + 1) * self.span))  # no question of this bucket is later
            self.entries.put([(*at, value) for at, value in sorted(held.items())])
        asked = got[got["id"].notna()]
        if not len(asked) or not held:
            return iter([])
        times: dict[str, list[int]] = {}
        for name, at in sorted(held):
            times.setdefault(name, []).append(at)
        found = []
        for name, us, own in zip(asked["key"], asked["us"], asked["id"]):
            mine = times.get(name, ())
            place = bisect_right(mine, us) - 1
            if place >= 0 and us - mine[place] <= self.lifetime:
                found.append((own, mine[place], held[name, mine[place]]))
        out = pd.DataFrame(found, columns=["id", "at", "value"])
        return iter([out.assign(at=pd.to_datetime(out["at"].astype("int64"), unit="us"))] if found else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        return iter([])

    def close(self) -> None:
        pass


def as_of(stream: DataFrame, lifetime: int, lateness: str = "1 hour") -> DataFrame:
    """(id, at, value): the entry each question gets, of a stream of (key, ts, id, value).

    A row with an id is a question, one without is an entry; `lifetime` in seconds. Rows later than `lateness` behind the newest are dropped.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = F.lit(lifetime * 1_000_000 * SPAN)
    bucket = F.floor(micros / width)
    rows = stream.where("key IS NOT NULL AND ts IS NOT NULL AND (id IS NOT NULL OR value IS NOT NULL)") \
        .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    last = (F.col("id").isNull()) & (micros >= (bucket + 1) * width - F.lit(lifetime * 1_000_000))
    buckets = F.when(last, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    shard = F.pmod(F.xxhash64("key"), F.lit(SHARDS)).alias("shard")
    dealt = rows.select(shard, "key", F.explode(buckets).alias("bucket"), "ts", micros.alias("us"), "id", "value")
    return dealt.groupBy("shard", "bucket").transformWithStateInPandas(
        AsOf(lifetime), "id string, at timestamp_ntz, value string", outputMode="Append", timeMode="EventTime")


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def drain(answers: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that is there once and stop; answers are appended to a parquet folder."""
    with rocks_state(answers.sparkSession):
        query = answers.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
            .outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
