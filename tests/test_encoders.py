import hashlib
import math
from collections import Counter

import pytest

from deskspark.functions.encoders import hashed_vectors
from deskspark.operators import retrieval as RT
from deskspark.operators import vectors as V
from deskspark.settings import Settings

DOCS = [(1, "reset the password of your account on the login page"), (2, "monthly invoices are sent to the owner"),
        (3, "The THE the  the\npassword"), (4, ""), (5, None), (6, "  \n ")]


def plain(text, dim):
    counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in (text or "").lower().split())
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return [counts[b] / norm for b in range(dim)] if norm else None


@pytest.mark.parametrize("dim", [64, 7, 1])
def test_vectors_equal_plain_ones(spark, dim):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r.doc_id: r.vector for r in hashed_vectors(rows, "doc_id", dim=dim).collect()}
    assert got == {i: v for i, t in DOCS if (v := plain(t, dim))}  # texts without a word have no vector


def test_a_rewrite_is_searched_by_its_own_vector(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    stored = V.build(hashed_vectors(docs, "doc_id"))
    encoder = lambda rows: hashed_vectors(rows, "query_id")
    asked = spark.createDataFrame(
        [(1, "monthly invoices are sent", "reset the password of your account"), (2, "monthly invoices are sent", "short"), (3, "", None)],
        "query_id long, text string, rewrite string")
    settings = Settings(use_hybrid=False, use_rerank=False)
    found = RT.standard_retrieval(asked, docs, stored, None, 1, settings, encoder)
    assert {r.query_id: r.doc_id for r in found.collect()} == {1: 1, 2: 2}  # nothing is near a query without words
    varied = asked.selectExpr("query_id", "text", "CAST(NULL AS STRING) AS parts", "rewrite AS variants").where("query_id = 1")
    # the mode follows the settings
    both = RT.retrieve(varied, docs, stored, RT.text_index(docs), 2, Settings(use_rerank=False, use_variants=True), encoder)
    assert {r.doc_id for r in both.collect()} == {1, 2}
    one = RT.retrieve(varied, docs, stored, None, 1, Settings(use_rerank=False), encoder)
    assert {r.doc_id for r in one.collect()} == {2}


def test_probe_shows_the_first_characters_in_one_line(spark):
    docs = spark.createDataFrame([(1, "first\nline " + "x" * 200), (2, "far away")], "doc_id long, text string")
    stored = V.build(hashed_vectors(docs, "doc_id"))
    asked = hashed_vectors(docs.where("doc_id = 1").withColumnRenamed("doc_id", "query_id"), "query_id")
    got = RT.probe(asked, docs, stored, 1).collect()
    assert [(r.doc_id, r.preview) for r in got] == [(1, ("first line " + "x" * 200)[:150])]


def test_counts_of_a_row_are_shuffled_once(spark):
    """No row a (text, bucket) is shuffled; rows that share a key add up, rows without a word have no vector."""
    rows = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (3, " "), (None, "x")], "doc_id long, text string")
    vectors = hashed_vectors(rows, "doc_id", dim=64)
    assert vectors._jdf.queryExecution().sparkPlan().toString().count("Generate") == 0
    assert vectors._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.doc_id: r.vector for r in vectors.collect()}
    assert got.keys() == {1, None} and got[1] == hashed_vectors(spark.createDataFrame([(1, "a a b b c")], rows.schema), "doc_id").first().vector
