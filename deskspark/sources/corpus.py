"""Knowledge-base sources: markdown folders, stored chunk and keyword indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark import schemas
from deskspark.operators.chunking import build_chunks
from deskspark.operators.index import KeywordIndex, build_keyword_index
from deskspark.sinks import tables
from deskspark.settings import DEFAULTS, Settings


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.md file below a folder: (source, text). Fails when there is none."""
    docs = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    )
    if docs.isEmpty():
        raise FileNotFoundError(f"no markdown files below {folder}")
    return docs


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five customer tables with their declared schemas."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}")
        for name, schema in schemas.CUSTOMER_TABLES.items()
    }


def load_or_build_chunks(
    spark: SparkSession, path: str, read_docs: Callable[[], DataFrame], force: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Stored chunks when there are any, else (or when forced) built from the documents."""
    if force or not tables.table_exists(spark, path):
        tables.write_chunks(build_chunks(read_docs(), settings), path)
    return spark.read.schema(schemas.CHUNKS).parquet(path)


def store_keyword_index(index: KeywordIndex, path: str) -> None:
    tables.write_keyword_index(index.postings, f"{path}/postings")
    tables.overwrite(index.lengths, f"{path}/lengths")
    tables.overwrite(index.terms, f"{path}/terms")
    tables.overwrite(index.corpus, f"{path}/corpus")


def load_or_build_index(spark: SparkSession, path: str, chunks: DataFrame) -> KeywordIndex:
    """Stored keyword index; rebuilt when missing or unreadable."""
    try:
        return _read_index(spark, path)
    except AnalysisException:
        store_keyword_index(build_keyword_index(chunks, "chunk_id", "content"), path)
        return _read_index(spark, path)


def _read_index(spark: SparkSession, path: str) -> KeywordIndex:
    return KeywordIndex(*[
        spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "terms", "corpus")
    ])


def drop_index(spark: SparkSession, *paths: str) -> list[bool]:
    return [tables.drop_table(spark, p) for p in paths]
