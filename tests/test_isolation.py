"""Batch functions that fail on some rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskspark.functions.isolation import bisected, isolated, isolated_answers
from deskspark.operators import chunking as E
from deskspark.operators import retrieval as RT


def picky(xs):
    if any(x == 13 for x in xs):
        raise ValueError("unlucky")
    return [2 * x for x in xs]


@pytest.mark.parametrize("n, bad", [(0, []), (1, []), (1, [0]), (10_000, [4321]), (97, [0, 1, 50, 96]), (8, list(range(8)))])
def test_only_the_rows_that_fail(n, bad):
    calls = []

    def fn(xs):
        calls.append(len(xs))
        return picky(xs)

    rows = [13 if i in bad else i + 100 for i in range(n)]
    values, errors = bisected(fn, [rows])
    assert [i for i, e in enumerate(errors) if e] == bad and all("ValueError: unlucky" == errors[i] for i in bad)
    assert all(values[i] == (None if i in bad else 2 * rows[i]) for i in range(n))
    assert len(calls) <= 1 + 2 * len(bad) * max(1, n.bit_length())


def test_wrong_number_of_values():
    values, errors = bisected(lambda xs: [1] if len(xs) > 1 else [2], [[0, 0, 0]])
    assert values == [2, 2, 2] and errors == [None] * 3
    assert bisected(lambda xs: [], [[0]])[1] == ["ValueError: 0 values for 1 rows"]


def test_one_poisoned_row_in_ten_thousand(spark):
    def doubled(xs):  # a worker cannot import this module
        if any(x == 13 for x in xs):
            raise ValueError("unlucky")
        return [2 * x for x in xs]

    df = spark.range(10_000).select(F.when(F.col("id") == 777, F.lit(13)).otherwise(F.col("id") + 100).alias("x"))
    out = df.select("x", isolated(doubled, "long")(F.col("x")).alias("r")).select("x", "r.*")
    assert [(r.x, r.value) for r in out.where("error IS NOT NULL").collect()] == [(13, None)]
    assert out.where("error IS NULL AND value = 2 * x").count() == 9_999

    def model(pdf: pd.DataFrame) -> list[str]:
        return [str(v) for v in doubled(pdf["x"].tolist())]

    rows = isolated_answers(df, model)
    assert rows.where("error_message IS NOT NULL").select("x", "answer").collect() == [(13, None)]
    assert rows.where("answer = string(2 * x)").count() == 9_999


def test_documents_a_splitter_fails_on(spark):
    def splitter(text):
        if "bad" in text:
            raise KeyError("no")
        return text.split("#")

    df = spark.createDataFrame([(1, "a#b##c"), (2, "bad#x"), (3, ""), (4, None)], "id int, content string")
    got = sorted((r.id, r.section, r.piece, r.content, r.error_message is not None) for r in E.split_or_fall_back(df, splitter).collect())
    assert got == [(1, 0, 0, "a", False), (1, 1, 0, "b", False), (1, 3, 0, "c", False), (2, 0, 0, "bad#x", True)]


def test_queries_a_scorer_fails_on(spark):
    def scorer(queries, texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [len(t) / 10 for t in texts]

    rows = [(q, i, "q", t, i + 1, 0.5) for q, texts in ((1, ["a", "bbb", "cc"]), (2, ["x", "bad", "yyyy"])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, query string, text string, rank int, score double")
    got = RT.rerank_or_keep(df, 2, isolated(scorer, "double")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.rank, r.score, r.error_message) for r in got] == [
        (1, 1, 1, 0.7, None), (1, 2, 2, 0.8, None), (2, 0, 1, 0.5, "RuntimeError: no"), (2, 1, 2, 0.5, "RuntimeError: no")]
