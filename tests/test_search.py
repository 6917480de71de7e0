import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskspark.functions import encoders
from deskspark.operators import index as IX
from deskspark.operators import ranking
from deskspark.operators import retrieval as RT
from deskspark.operators import vectors as V

RND = random.Random(7)
VOCAB = [f"w{i}" for i in range(40)]
DOCS = [(i, " ".join(RND.choices(VOCAB, k=RND.randint(3, 30)))) for i in range(60)] + [(100, "only here"), (101, "only here")]
QUERIES = [(i, " ".join(RND.choices(VOCAB + ["only"], k=6))) for i in range(12)]
VECS = [(i, [RND.uniform(-1, 1) for _ in range(5)]) for i in range(60)]


def okapi(docs, query):
    tokens = {i: t.lower().split() for i, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(t for ws in tokens.values() for t in set(ws))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for i, ws in tokens.items():
        tf = Counter(ws)
        out[i] = sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for t in query.lower().split())
    return out


def top(scores, k):
    pairs = [(round(s, 9), d) for d, s in scores.items() if round(s, 9) > 0]
    return sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    return docs, queries, IX.stored_index(docs)


MODES = {"held": {}, "stored": {"MAX_HELD_ROWS": 0}, "slices": {"MAX_CELLS": 20}}


@pytest.mark.parametrize("mode", MODES)
def test_bm25_every_way(frames, monkeypatch, mode):
    for name, value in MODES[mode].items():
        monkeypatch.setattr(ranking, name, value)
    docs, queries, ix = frames
    got = {}
    for r in ranking.keyword_top(queries, docs, ix.terms, ix.corpus, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.doc_id))
    for q, text in QUERIES:
        want = top(okapi(DOCS, text), 5)
        assert [d for _, d in got[q]] == [d for _, d in want]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want], atol=1e-8)


def test_hybrid_against_brute_force(spark, frames):
    docs, queries, _ = frames
    qv = spark.createDataFrame([(i, VECS[i][1]) for i, _ in QUERIES], "query_id long, vector array<double>")
    v = spark.createDataFrame(VECS, "doc_id long, vector array<double>")
    k, alpha = 4, 0.7
    got = {}
    for r in RT.hybrid_search(queries.join(qv, "query_id"), V.build(v), RT.text_index(docs), k, alpha).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    texts, vecs = dict(DOCS), dict(VECS)
    for q, text in QUERIES:
        near = sorted((round(sum((x - y) ** 2 for x, y in zip(vecs[q], b)), 9), j) for j, b in VECS)[:2 * k]
        kw = okapi(DOCS, text)
        best = max(kw.values()) or 1
        sem = {texts[j]: 1 / (1 + d) for d, j in near}
        owner = {}
        for _, j in near:
            owner.setdefault(texts[j], j)
        by_text = {texts[d]: s / best for d, s in kw.items()}
        fused = {t: alpha * sem.get(t, 0) + (1 - alpha) * by_text.get(t, 0) for t in set(sem) | set(by_text)}
        want = [t for t, _ in sorted(fused.items(), key=lambda p: -round(p[1], 9))[:k] if t in sem]
        assert [d for d, _ in got.get(q, [])] == [owner[t] for t in want]
        assert np.allclose([s for _, s in got.get(q, [])], [1 - fused[t] for t in want], atol=1e-8)


def test_rrf_ties_and_repeats(spark):
    rows = [(1, 0, 10, "a", 1), (1, 0, 11, "b", 2), (1, 1, 11, "b", 1), (1, 1, 12, "c", 2), (1, 1, 13, "a", 2)]
    df = spark.createDataFrame(rows, "query_id int, list_id int, doc_id int, content_key string, rank int")
    got = [(r.doc_id, r.score) for r in RT.reciprocal_rank_fusion(df).orderBy("rank").collect()]
    both = round(1 / 61 + 1 / 62, 9)
    assert got == [(10, both), (11, both), (12, round(1 / 62, 9))]


def test_rerank_with_user_scorer(spark):
    rows = [(1, i, "q", t, i + 1, 0.5) for i, t in enumerate(["a", "bbb", "cc"])] + [(2, 9, "q", "x", 1, 0.25)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, query string, text string, rank int, score double")
    scorer = encoders.batch_scorer(lambda qs, ts: [len(t) / 10 for t in ts])
    got = [(r.query_id, r.doc_id, r.rank, r.score) for r in RT.rerank(df, 2, scorer).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 0.7), (1, 2, 2, 0.8), (2, 9, 1, 0.25)]


def col(spark, values, fn):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("a"), F.col("b"))).collect()]


def test_query_handling(spark):
    lines = "1. first variant\n\n 2) second variant\nshort\n3.third variant x\n4. fourth variant"
    assert col(spark, [("how to do it", lines), ("too short", lines), ("how to do it", None)], lambda a, b: RT.query_variants(a, b, 3)) == [
        ["how to do it", "first variant", "second variant", "third variant x"], ["too short"], ["how to do it"]]
    long = "one two three four five six seven eight nine ten and eleven"
    assert col(spark, [(long, lines), (long, "x"), ("a and b", lines)], RT.sub_queries) == [
        ["first variant", "second variant", "third variant x"], [long], ["a and b"]]
    clear = "is this one not a clear enough question now ?"
    assert col(spark, [("q", " a rewrite of it "), ("q", "x" * 200), ("q", "x" * 10), ("q", None), (clear, "a rewrite of it")], RT.accepted_rewrite) == [
        "a rewrite of it", "q", "q", "q", clear]


def test_compression(spark):
    text = "The cat. A dog! The cat. Red bird sings. Blue."
    got = col(spark, [("cat bird.", text), ("zzz", text), ("cat", "One. Two.")], lambda q, c: RT.compress(q, c, 2))
    assert [r.content for r in got] == ["The cat. A dog!", "The cat. A dog!", "One. Two."]
    got = col(spark, [("the red", text)], lambda q, c: RT.compress(q, c, 2))
    assert got[0].content == "The cat. The cat." and got[0].compressed


def test_hashing_encoder(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "t string")
    rows = encoders.encode(df, "t", lambda c: encoders.hashing_vector(c, 16)).collect()
    assert abs(sum(x * x for x in rows[0].vector) - 1) < 1e-12 and sum(rows[1].vector) == 0
    user = encoders.batch_encoder(lambda ts: [[float(len(t))] for t in ts])
    assert [r.vector for r in encoders.encode(df, "t", user).collect()] == [[5.0], [0.0]]
