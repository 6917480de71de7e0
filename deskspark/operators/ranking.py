"""Keyword search of many passing queries against a document set that a task can hold.

The documents, when they are within a checked size, are sent to every task as one compact block, and each query is finished where
it is read: nothing is shuffled. A larger set is searched through a stored index (operators/postings.py).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deskspark import rules as R
from deskspark.functions import text as X
from deskspark.operators import postings

MAX_HELD_ROWS = 50_000
MAX_HELD_BYTES = 64 << 20
MAX_CELLS = 250_000
MAX_SLICE = 2048
DIGITS = 9

# block scorer: made from the held documents, maps a batch of queries to a score matrix with one row per document
# and one column per query; NaN marks a pair that is no candidate
Scorer = Callable[[pd.DataFrame], np.ndarray]


def _fits(docs: DataFrame) -> bool:
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return n <= MAX_HELD_ROWS and (size or 0) <= MAX_HELD_BYTES


def _best(scores: np.ndarray, ids: list, k: int) -> list[tuple[float, object]]:
    """k best (score, id), higher score first, then lower id."""
    scores = np.round(scores, DIGITS)
    known = np.flatnonzero(~np.isnan(scores))
    if len(known) > k:
        kth = np.partition(scores[known], len(known) - k)[len(known) - k]
        known = known[scores[known] >= kth]
    pairs = [(float(scores[i]), ids[i]) for i in known]
    pairs.sort(key=lambda p: (-p[0], p[1]))
    return pairs[:k]


def _rows(found: dict) -> pd.DataFrame:
    flat = [(q, d, s, i) for q, pairs in found.items() for i, (s, d) in enumerate(pairs, start=1)]
    return pd.DataFrame(flat, columns=["query_id", "doc_id", "score", "rank"])


def _slices(batch: pa.RecordBatch, held: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose score matrix stays within a number of cells, of MAX_SLICE rows at most."""
    rows = max(1, min(MAX_SLICE, cells // max(held, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _pass_queries(held_ids: list, score: Scorer, k: int, schema: T.StructType):
    """Documents held, queries passing: every query row is finished on the spot."""
    cells, arrow_schema = MAX_CELLS, to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, len(held_ids), cells):
                part = some.to_pandas()  # words of a slice alone become Python objects
                matrix = score(part)
                found = _rows({
                    q: _best(matrix[:, col], held_ids, k) for col, q in enumerate(part["query_id"])
                })
                yield pa.RecordBatch.from_pandas(found, arrow_schema, preserve_index=False)

    return run


class TermBlock:
    """Held side as a sparse term x row table; scores a batch of passing rows at once."""

    def __init__(self, rows: list[dict[str, float]]):
        self.size = len(rows)
        self.terms = {t: i for i, t in enumerate(sorted({t for r in rows for t in r}))}
        at = [(self.terms[t], i, w) for i, r in enumerate(rows) for t, w in r.items()]
        at.sort()
        cells = np.array(at, dtype=np.float64).reshape(len(at), 3)
        self.rows, self.weights = cells[:, 1].astype(np.int64), cells[:, 2]
        self.starts = np.searchsorted(cells[:, 0], np.arange(len(self.terms) + 1))

    def scores(self, passing: list[dict[str, float]]) -> np.ndarray:
        """One row per held row, one column per passing row; NaN where nothing is shared."""
        term, col, weight = [], [], []
        for j, row in enumerate(passing):
            for t, w in row.items():
                number = self.terms.get(t)
                if number is not None:
                    term.append(number)
                    col.append(j)
                    weight.append(w)
        term = np.array(term, dtype=np.int64)
        first, last = self.starts[term], self.starts[term + 1]
        count = last - first
        # one entry per (passing term, held row): run numbers first..last of every term, laid end to end
        run = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        cell = self.rows[run] * len(passing) + np.repeat(np.array(col, dtype=np.int64), count)
        value = self.weights[run] * np.repeat(np.array(weight), count)
        out = np.bincount(cell, weights=value, minlength=self.size * len(passing)).reshape(self.size, len(passing))
        return np.where(out > 0, out, np.nan)


def _doc_weights(words: list[str], avgdl: float, wanted) -> dict[str, float]:
    norm = R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * len(words) / avgdl)
    counts = Counter(t for t in words if t in wanted)
    return {t: c * (R.BM25_K1 + 1) / (c + norm) for t, c in counts.items()}


def keyword_top(queries: DataFrame, docs: DataFrame, terms: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """k best documents by BM25: (query_id, doc_id, score, rank); only positive scores, ties to the lower id.

    Inputs are (query_id, text), (doc_id, text) and the term and corpus tables of the index the
    scores refer to, which may cover more documents than `docs`.
    """
    if not _fits(docs):
        index = postings.create(docs.select("doc_id", "text"))
        return postings.search(queries, replace(index, terms=terms, corpus=corpus, avgdl=corpus.first()["avgdl"]), k)
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType()),
    ])
    words = F.coalesce(X.words(F.col("text")), F.array().cast("array<string>")).alias("words")
    held = docs.select("doc_id", words).toPandas().drop_duplicates("doc_id")
    mine = docs.select(F.explode(words).alias("term")).distinct()
    idf = {r["term"]: r["idf"] for r in terms.join(mine, "term", "left_semi").select("term", "idf").collect()}
    avgdl = corpus.first()["avgdl"]
    block = TermBlock([{t: w * idf[t] for t, w in _doc_weights(row, avgdl, idf).items()} for row in held["words"]])

    def score(batch: pd.DataFrame) -> np.ndarray:
        return block.scores([Counter(row) for row in batch["words"]])

    # each query met every document in one place, so its ranks are final: nothing to shuffle
    return queries.select("query_id", words).mapInArrow(_pass_queries(held["doc_id"].tolist(), score, k, schema), schema)
