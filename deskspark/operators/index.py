"""Keyword index tables: postings, document lengths, term statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark.functions import text as X
from deskspark.session import materialise


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame   # doc_id, term, tf
    lengths: DataFrame    # doc_id, dl
    terms: DataFrame      # term, df, idf
    corpus: DataFrame     # n, avgdl (one row)


def _words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), X.words(F.col(text)).alias("words"))


def _document_frequencies(tokens: DataFrame) -> DataFrame:
    """Documents per term. Repeats are dropped inside the row, so only counts combined map-side
    are shuffled: a term that is in every document arrives as one row per task."""
    terms = tokens.select(F.explode(F.array_distinct("words")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def _corpus(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))


def build_keyword_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> KeywordIndex:
    """All index tables of a document set."""
    tokens = _words(docs, doc_id, text)
    postings = tokens.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(
        F.count("*").alias("tf"))
    corpus = _corpus(tokens)
    terms = term_weights(_document_frequencies(tokens), corpus)
    return KeywordIndex(postings, tokens.select("doc_id", F.size("words").alias("dl")), terms, corpus)


def stored_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> KeywordIndex:
    """The same with its statistics written once to the shared folder, for repeated use."""
    tokens = _words(docs, doc_id, text)
    corpus = materialise(_corpus(tokens), "corpus")
    counts = materialise(_document_frequencies(tokens), "counts")
    return replace(build_keyword_index(docs, doc_id, text), terms=term_weights(counts, corpus), corpus=corpus)


def term_weights(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """idf per term; a negative idf becomes a fixed share of the mean idf."""
    n = corpus.select("n").scalar()
    raw = counts.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("m")).select("m").scalar()
    idf = F.when(F.col("raw") < 0, mean * R.BM25_EPSILON).otherwise(F.col("raw"))
    return raw.select("term", "df", idf.alias("idf"))


def tf_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """Saturated, length-normalised term frequency."""
    norm = R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * dl / avgdl)
    return tf * (R.BM25_K1 + 1) / (tf + norm)
