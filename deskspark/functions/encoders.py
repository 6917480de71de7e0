"""Text-to-vector encoders. Any `DataFrame -> DataFrame` adding an array column may stand in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskspark.functions import text as X


def hashing_vector(text: Column, dim: int = 256) -> Column:
    """Unit-length bag-of-words vector: token counts by hash bucket. Built-in columns only."""
    def counts(buckets: Column) -> Column:
        return F.aggregate(
            buckets, F.array_repeat(F.lit(0.0), dim),
            lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)),
        )

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return X.let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))

    buckets = F.transform(X.words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return X.let(counts(buckets), unit)


def hashed_vectors(rows: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """(key, vector): the unit-length bag-of-words vector of each row with a word; rows that share a key add up.

    Work grows with the words alone: they are counted by bucket where they are read, and the `dim` counts of a row are what is
    shuffled. Documents and whatever is searched for must share `dim`.
    """
    kind = rows.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
                coded = batch.column(1).flatten().dictionary_encode()
                words = coded.dictionary.cast(pa.binary()).to_pylist()
                bucket = np.array([int(hashlib.md5(w).hexdigest()[:8], 16) % dim for w in words], np.int64)
                cell = np.repeat(np.arange(len(sizes)) * dim, sizes) + bucket[coded.indices.to_numpy()]
                counts = np.bincount(cell, minlength=len(sizes) * dim).reshape(-1, dim)[sizes > 0].astype(np.int32)
                ends = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(pa.array(sizes > 0)), pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], ["key", "counts"])

    counted = rows.select(key, X.words(F.col(text)).alias("words")).mapInArrow(count, f"key {kind}, counts array<int>")
    sums = counted.groupBy("key").agg(F.array(*[F.sum(F.get("counts", F.lit(b))) for b in range(dim)]).alias("counts"))
    norm = F.sqrt(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n * n))
    return sums.withColumn("norm", norm).select(F.col("key").alias(key), F.transform("counts", lambda n: n / F.col("norm")).alias("vector"))


def encode(df: DataFrame, text: str, encoder: Callable[[Column], Column], out: str = "vector") -> DataFrame:
    """Add a vector column with a column function: built-in expression or pandas UDF."""
    return df.withColumn(out, encoder(F.col(text)))


def batch_encoder(fn: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """Wrap a user's batch encoder (texts -> vectors) as an Arrow-batched column function."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fn(texts.tolist()))

    return run


def batch_scorer(fn: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """Wrap a user's pair scorer as an Arrow-batched column function for re-ranking."""
    @F.pandas_udf(T.DoubleType())
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(fn(queries.tolist(), texts.tolist()))

    return run


def batch_answers(mails: DataFrame, fn: Callable[[pd.DataFrame], list[str]], out: str = "answer") -> DataFrame:
    """Run a user's model function over Arrow batches; its JSON texts land in column `out`."""
    schema = T.StructType([*mails.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: fn(pdf)})

    return mails.mapInPandas(run, schema)
