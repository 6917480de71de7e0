"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
#: Slots of the bit table that marks keys of interest; 2**23 bits are 1 MB whatever the input.
SLOTS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts of single-byte characters take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS))


def slot_table(keys: DataFrame, *key: Column) -> DataFrame:
    """Bit table of the keys' hash slots: at most SLOTS / 32768 rows of 4 KB, so safe to broadcast.

    Rows of a key in the table always hit; others may. Work done for hits must not rely on it being exact.
    """
    slot = _slot(*key)
    return (
        keys.select(F.bitmap_bucket_number(slot).alias("__bucket"), F.bitmap_bit_position(slot).alias("__bit"))
        .groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )


def with_hit(df: DataFrame, slots: DataFrame, flag: str, *key: Column) -> DataFrame:
    """Add a boolean column: may the row's key be in the slot table?"""
    slot = _slot(*key)
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = df.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(slots), "__bucket", "left")
    hit = F.getbit(byte, (bit % 8).cast("int")) == 1
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__bucket", "__bits")


def id_hash(c: Column) -> Column:
    """crc32 of an id as text, the same in every engine."""
    return F.crc32(c.cast("string").cast("binary"))
