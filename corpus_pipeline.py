"""A training-data pipeline over `documents`: language, exact and near copies, mixing, tokens."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from deskspark.llm import bpe, exact_dedup, langid, mixing, simhash
from deskspark.llm.common import table
from deskspark.llm.queries import vocabulary
from deskspark.session import shared_dir, ship

#: SQL cannot express the language, fingerprint and token stages; tests compare them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; the labels to learn from are those of the documents themselves."""
    ship(spark)
    return langid.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    ship(spark)
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of three-word shingles within three bits the smallest id stays, as the operator's query groups them."""
    ship(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the decoded text."""
    ship(spark)
    path, pattern = vocabulary()
    return bpe.encode(docs, path, pattern)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    root = shared_dir(spark)
    for name, stage in STAGES:
        path = os.path.join(root, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
