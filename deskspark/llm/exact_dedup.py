"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are grouped by byte length, then by the hash of a prefix, and only rows of groups that are still
shared have their whole text hashed. Length and prefix hash come from one scan and meet as counts, so a
group of any size is one row per task before it is shuffled. Which (length, prefix) groups survive is
told to the second scan by a bit table of fixed size: a false hit costs one more hash and changes nothing.

Texts are equal when the same after lower-casing A-Z; null counts as empty. The largest id of a group
stays; a null id ranks lowest, and a group with null ids only keeps them all. Rows that repeat an id and a
text are one document listed twice: they share the decision. Other columns are neither read nor required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.llm.common import ascii_lower, filled, slot_table, with_hit
from deskspark.session import materialise

PREFIX_CHARS = 256


def _length(text: str) -> Column:
    return F.octet_length(filled(F.col(text)))


def _prefix(text: str) -> Column:
    return F.xxhash64(ascii_lower(F.substring(filled(F.col(text)), 1, PREFIX_CHARS)))


def _full(text: str) -> Column:
    return F.sha2(ascii_lower(filled(F.col(text))), 256)


def shared_prefixes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(length, prefix hash) groups of two or more rows, found among the lengths of two or more rows."""
    keys = docs.select(_length(text).alias("len"), _prefix(text).alias("prefix")) \
        .groupBy("len", "prefix").agg(F.count("*").alias("n"))
    lengths = keys.groupBy("len").agg(F.sum("n").alias("rows")).where("rows > 1").select("len")
    return keys.where("n > 1").join(lengths, "len", "left_semi").select("len", "prefix")


def _hits(docs: DataFrame, text: str) -> DataFrame:
    found = materialise(shared_prefixes(docs, text), "shared_prefixes")
    slots = slot_table(found, F.col("len"), F.col("prefix"))
    return with_hit(docs, slots, "__hit", _length(text), _prefix(text))


def _groups(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("hash").agg(F.max("id").alias("keep"), F.count("*").alias("size"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(id_col, keep_id, group_size, kept), one row per input row; with `digest` also text_sha256 of every text."""
    id_name = id_col
    full = _full(text)
    hashed = _hits(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text")
    full = _full("text")
    hashed = hashed.select("id", F.col("__hit").alias("hit"), F.unhex(full if digest else F.when(F.col("__hit"), full)).alias("hash"))
    rows = materialise(hashed, "full_hashes")
    alone = rows.where("not hit").select(
        "id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), "hash")
    met = rows.where("hit").join(_groups(rows.where("hit")), "hash").select("id", "keep", "size", "hash")
    out = alone.unionByName(met).select(
        F.col("id").alias(id_name), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("hash")).alias("text_sha256"))
    return out if digest else out.drop("text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with. Only texts of shared groups are shuffled."""
    flagged = _hits(docs, text)
    met = flagged.where("__hit").withColumn("__hash", _full(text))
    groups = _groups(met.select(F.col(id_col).alias("id"), F.col("__hash").alias("hash")))
    stay = materialise(groups.select("hash", "keep"), "kept_ids")
    kept = met.join(stay, (met["__hash"] == stay["hash"]) & met[id_col].eqNullSafe(stay["keep"]), "left_semi")
    return flagged.where("not __hit").select(*docs.columns).unionByName(kept.select(*docs.columns))
