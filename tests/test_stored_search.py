"""Stored vectors and stored postings against brute force: pruning and skipping change nothing."""

import hashlib
import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from deskspark.operators import postings as P
from deskspark.operators import retrieval as RT
from deskspark.operators import vectors as V


def near(queries, items, k):
    out = {}
    for q, a in queries:
        if a is not None:
            d = sorted((round(float(((np.array(a) - np.array(b)) ** 2).sum()), 9), i) for i, b in items)[:k]
            out[q] = d
    return out


def got_near(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.distance, r.doc_id))
    return out


def clustered(n, dims, groups, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims)) * 10
    return (centers[rng.integers(groups, size=n)] + rng.normal(size=(n, dims)) * 0.3).tolist()


@pytest.mark.parametrize("block, cells, pack, probes", [(1024, 1024, 2048, 4), (7, 5, 3, 1), (3, 1, 2048, 2)])
def test_vector_search_is_exact(spark, monkeypatch, block, cells, pack, probes):
    for name, value in (("BLOCK", block), ("CELLS", cells), ("PACK", pack), ("PROBES", probes)):
        monkeypatch.setattr(V, name, value)
    rows = clustered(150, 5, 6, 1)
    items = [*enumerate(rows), *[(500 + i, rows[0]) for i in range(70)]]  # a third of all rows are equal
    junk = [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * 5), (903, [None] * 5), (904, []), (None, rows[1])]
    v = spark.createDataFrame([*items, *junk], "doc_id long, vector array<double>").selectExpr("*", "1 AS cell", "2 AS block")
    queries = [*items[:40], *[(1000 + i, x) for i, x in enumerate(clustered(15, 5, 6, 2))]]
    q = spark.createDataFrame([*queries, (2000, None), (2001, [1.0])], "query_id long, vector array<double>")
    index = V.build(v.repartition(3))
    assert index.blocks.agg(F.sum("n"), F.max("n")).first()[0] == len(items)
    for k in (4, 90) if block < 1024 else (300,):  # fewer stored than asked
        assert got_near(V.search(q, index, k)) == near(queries, items, k)


def test_vector_search_prunes(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rows = clustered(1500, 8, 30, 3)
    v = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(rows)], "doc_id string, vector array<double>")
    q = v.where(F.substring("doc_id", 2, 9).cast("int") % 25 == 0).withColumnRenamed("doc_id", "query_id")
    index = V.build(v)
    w = V.work(q, index, 4).first()
    assert (w.queries, w.stored) == (60, 1500) and w.share < 0.25
    assert got_near(V.search(q, index, 4)) == near([(f"d{i}", x) for i, x in enumerate(rows) if i % 25 == 0], [(f"d{i}", x) for i, x in enumerate(rows)], 4)
    plan = V.search(q, index, 4)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rings_stay_where_they_are(spark, monkeypatch):
    """Neither rings nor queries are shuffled: a task gives its k best of a query, also of vectors without structure, in packs of any size."""
    monkeypatch.setattr(V, "BLOCK", 16)
    rows = [*enumerate(np.random.default_rng(5).normal(size=(600, 8)).tolist())]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    index, q = V.build(v), v.withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(V, "PACK", 250, raising=False)
    found = V.search(q, index, 3)
    assert got_near(found) == near(rows, rows, 3)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and "Join" not in plan
    asked, packs = V._asked(q, V._cells(index), V._rings(index))
    assert sum(len(p) for p in packs) == asked.count() and len(packs) >= 3
    ids, vectors, first = V._held(asked, packs[0], 8)
    none = np.full(len(ids), np.inf)
    given = V._stored(index).mapInArrow(V._meet(vectors, none, V._cells(index), 3, None, ids), "query_id long, doc_id long, distance double")
    assert given.count() <= len(ids) * 3 * V.TASKS * spark.sparkContext.defaultParallelism


def test_vectors_of_floats_are_stored_as_such(spark):
    v = spark.range(50).selectExpr("id AS doc_id", "array(float(id), float(0.1)) AS vector")
    index = V.build(v)
    assert index.blocks.schema["vectors"].dataType.simpleString() == "array<float>"
    got = got_near(V.search(v.where("doc_id = 7").withColumnRenamed("doc_id", "query_id"), index, 3))
    assert got == {7: [(0.0, 7), (1.0, 6), (1.0, 8)]}


def test_many_equal_vectors(spark):
    """More rows at the k-th distance than k: the lowest ids are found, wherever they lie."""
    v = spark.range(3000).selectExpr("id AS doc_id", "array(1D, 2D) AS vector")
    got = got_near(V.search(v.where("doc_id % 1000 = 5").withColumnRenamed("doc_id", "query_id"), V.build(v), 4))
    assert got == {q: [(0.0, i) for i in range(4)] for q in (5, 1005, 2005)}


def test_vectors_are_stored(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0])], "doc_id int, vector array<float>")
    reads = []

    def read():
        reads.append(1)
        return v

    for _ in range(2):
        index = V.load_or_build(spark, str(tmp_path / "v"), read)
    assert reads == [1]
    q = spark.createDataFrame([(7, [2.5, 1.0])], "query_id int, vector array<double>")
    assert [tuple(r) for r in V.search(q, index, 2).orderBy("rank").collect()] == [(7, 2, 0.25, 1), (7, 1, 6.25, 2)]


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert V.search(q, V.build(none), 3).count() == 0
    assert V.search(q.limit(0), V.build(q.withColumnRenamed("query_id", "doc_id")), 3).count() == 0


# ---- postings ------------------------------------------------------------------------------

def okapi(docs, query, copies=None):
    copies = copies or {}
    tokens = {i: (t or "").lower().split() for i, t in docs}
    n = sum(copies.get(i, 1) for i in tokens)
    avg = sum(len(w) * copies.get(i, 1) for i, w in tokens.items()) / n
    df = Counter()
    for i, ws in tokens.items():
        for t in set(ws):
            df[t] += copies.get(i, 1)
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for i, ws in tokens.items():
        tf = Counter(ws)
        out[i] = sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for t in query.lower().split())
    return out


def best(scores, k):
    pairs = [(round(s, 6), d) for d, s in scores.items() if round(s, 9) > 0]
    return sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.score, 6), r.doc_id))
    return out


def library(n, seed):
    """Texts with a few words of every text, many rare ones, copies, and nothing at all."""
    rng = random.Random(seed)
    rare = [f"r{i}" for i in range(300)]
    docs = []
    for i in range(n):
        words = rng.choices(["the", "of", "and"], k=rng.randint(1, 9)) + rng.choices(rare, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 12))
        rng.shuffle(words)
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    return [*docs, (n, None), (n + 1, ""), *[(n + 2 + i, "The SAME text of r5 r7") for i in range(40)]]


QUERIES = [(0, "the of r5"), (1, "r7 r7 r250 the"), (2, "unknown"), (3, "r1 r2 r3 r4 r5 r6 r9 the and"), (4, ""), (5, "The"), (6, "r40 r41 R42")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([*QUERIES, (9, None)], "query_id long, text string")


@pytest.mark.parametrize("block, first_terms, candidates, direct", [(128, 8, 4, 1 << 18), (4, 1, 1, 0), (1, 2, 1, 60)])
def test_skipped_blocks_change_nothing(spark, asked, monkeypatch, block, first_terms, candidates, direct):
    for name, value in (("BLOCK", block), ("FIRST_TERMS", first_terms), ("FIRST_CANDIDATES", candidates), ("DIRECT", direct)):
        monkeypatch.setattr(P, name, value)
    docs = library(250, 5)
    df = spark.createDataFrame([*docs, (None, "the r5")], "doc_id long, text string").selectExpr("*", "'x' AS term", "1 AS n")
    index = P.create(df.repartition(3))
    for k in (1, 60):
        assert found(P.search(asked, index, k)) == {q: b for q, t in QUERIES if (b := best(okapi(docs, t), k))}
    want = {q: b for q, t in QUERIES if (b := best(okapi(docs, t), 5))}
    assert found(P.search(asked, index, 5, skip=False)) == want
    monkeypatch.setattr(P, "DEAR", 0.0)  # no candidate is dear: all are scored from forward rows
    assert found(P.search(asked, index, 5)) == want
    if block < 128:
        w = P.work(asked, index, 1).first()
        assert w.read < 0.6 * w.held


def test_segments_add_up(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FANOUT", 3)
    docs = library(160, 6)
    parts = [docs[i::4] for i in range(4)]
    frames = [spark.createDataFrame(p, "doc_id long, text string") for p in parts]
    path = str(tmp_path / "index")
    index = P.load_or_create(spark, path, lambda: frames[0])
    seen = [len(index.segments)]
    for f, p in zip(frames[1:], parts[1:]):
        index = P.append(index, f.unionByName(spark.createDataFrame([(p[0][0], "another text of a known id")], "doc_id long, text string").limit(0)))
        index = P.append(index, frames[0])  # all known: nothing is added
        seen.append(len(index.segments))
    assert seen == [1, 2, 1, 2]  # three of a tier become one
    again = P.load_or_create(spark, path, lambda: pytest.fail("the stored index is read"))
    assert again.version == index.version and sum(s.documents for s in again.segments) == len(docs)
    want = {q: b for q, t in QUERIES if (b := best(okapi(docs, t), 7))}
    assert found(P.search(asked, again, 7)) == want == found(P.search(asked, P.create(spark.createDataFrame(docs, "doc_id long, text string")), 7))
    assert P.tier(0) == P.tier(1) == 0 and P.tier(9) == 2


def test_append_reads_new_texts_only(spark, tmp_path):
    old = tmp_path / "old.parquet"
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(old))
    index = P.create(spark.read.parquet(str(old)), str(tmp_path / "index"))
    new = spark.createDataFrame([(1, "changed"), (2, "b c")], "doc_id long, text string")
    grown = P.append(index, new)
    files = [f for frame in (grown.blocks, grown.forward, grown.terms) for f in frame.inputFiles()]
    assert files and not any("old.parquet" in f for f in files)
    assert {r.term: r.df for r in grown.terms.collect()} == {"a": 1, "b": 2, "c": 1}
    assert grown.corpus.first().n == 2


def test_a_segment_of_nothing(spark, asked):
    index = P.create(spark.createDataFrame([], "doc_id string, text string"))
    assert P.search(asked, index, 3).count() == 0
    grown = P.append(index, spark.createDataFrame([("x", "the r5"), ("y", "r5"), ("z", "r9")], "doc_id string, text string"))
    assert [r.doc_id for r in P.search(asked.where("query_id = 6"), grown, 3).collect()] == []
    assert {r.doc_id for r in P.search(asked.where("query_id = 3"), grown, 3).collect()} <= {"x", "y", "z"}


def test_pair_scores(spark, asked):
    docs = library(60, 8)
    index = P.create(spark.createDataFrame(docs, "doc_id long, text string"))
    pairs = [(q, d) for q, _ in QUERIES for d in range(q, 60, 7)]
    got = {(r.query_id, r.doc_id): r.score for r in P.pair_scores(spark.createDataFrame(pairs * 2, "query_id long, doc_id long"), asked, index).collect()}
    want = {(q, d): okapi(docs, dict(QUERIES)[q])[d] for q, d in pairs}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in got)


def test_equal_texts_are_one_entry(spark):
    docs = [(i, "same words here") for i in range(30)] + [(100, "same other"), (101, "words alone"), (102, "x y z"), (103, None), (104, None)]
    index = RT.text_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert index.postings.forward.where("dl > 0").count() == 4
    q = spark.createDataFrame([(1, "same words alone")], "query_id long, text string")
    rows = P.search(q, index.postings, 5).orderBy("rank").collect()
    copies = {0: 30, 100: 1, 101: 1, 102: 1}
    kept = [(i, t) for i, t in docs if i in copies]
    scores = okapi([*kept, (103, None)], "same words alone", {**copies, 103: 2})
    by_key = {r.content_key: r.doc_id for r in index.members.groupBy("content_key").agg(F.min("doc_id").alias("doc_id")).collect()}
    got = {by_key[r.doc_id]: round(r.score, 6) for r in rows}
    # null texts have no key, so they are no entry of the statistics either
    scores = okapi(kept, "same words alone", copies)
    assert got == {d: s for s, d in best(scores, 5)}


def test_hybrid_without_a_keyword_index(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(1, "any", [2.2, 0.0])], "query_id long, text string, vector array<double>")
    rows = RT.hybrid_search(q, V.build(v), None, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(2, 0.04), (3, 0.64)]


def test_scores_of_another_corpus(spark, asked):
    """The statistics may cover more documents than the index that is searched."""
    docs = library(80, 9)
    whole = P.create(spark.createDataFrame(docs, "doc_id long, text string"))
    part = P.create(spark.createDataFrame(docs[:30], "doc_id long, text string"))
    index = replace(part, terms=whole.terms, corpus=whole.corpus, avgdl=whole.avgdl)
    want = {}
    for q, t in QUERIES:
        if b := best({d: s for d, s in okapi(docs, t).items() if d in dict(docs[:30])}, 5):
            want[q] = b
    assert found(P.search(asked, index, 5)) == want


def test_missing_index(spark, tmp_path):
    with pytest.raises(AnalysisException):
        P.load(spark, str(tmp_path / "none"))


def test_repeated_ids_are_one_document(spark, asked):
    """Rows that share an id add up, wherever they lie."""
    docs = library(60, 11)
    df = spark.createDataFrame([*docs, *docs[:20], docs[3]], "doc_id long, text string")
    index = P.create(df.repartition(5))
    idf = {r.term: r.idf for r in index.terms.collect()}
    rows = index.forward.collect()
    for name, k in (("few", 5), ("all", 300)):
        want = {}
        for q, t in QUERIES:
            scores = Counter()
            for r in rows:
                tf = dict(zip(r.words, r.tfs))
                scores[r.doc_id] += sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * r.dl / index.avgdl)) for w in t.lower().split() if w in tf)
            if b := best(scores, k):
                want[q] = b
        assert found(P.search(asked, index, k)) == want, name


def test_packs_and_slices_change_nothing(spark, asked, monkeypatch):
    docs = library(90, 12)
    index = P.create(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = {q: b for q, t in QUERIES if (b := best(okapi(docs, t), 6))}
    for pack, cells, step in ((3, 20, 5), (1 << 18, 1, 1)):
        for name, value in (("PACK", pack), ("CELLS", cells), ("STEP", step)):
            monkeypatch.setattr(P, name, value)
        assert found(P.search(asked, index, 6)) == want


def test_scores_are_not_shuffled(spark, monkeypatch):
    """A task gives its k best of a query, however many documents hold its terms."""
    docs = spark.range(0, 3000, 1, 3).selectExpr("id AS doc_id", "concat('the of r', id % 7) AS text")
    index = P.create(docs)
    q = spark.range(20).selectExpr("id AS query_id", "'the of r1' AS text")
    asked = P.materialise(P.query_weights(q, index.terms), "asked")
    assert P._scored_whole(asked, index, 2).count() <= 20 * 2 * index.forward.rdd.getNumPartitions()


def test_stored_rows_are_not_shuffled_by_a_search(spark, asked, monkeypatch):
    """What is asked is sent to blocks and forward rows, in packs if it is much; also where Spark would join by sorting."""
    docs = library(120, 13)
    index = P.create(spark.createDataFrame(docs, "doc_id long, text string"))
    want = {q: b for q, t in QUERIES if (b := best(okapi(docs, t), 5))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weights = P.materialise(P.query_weights(asked, index.terms), "weights")
        pairs = P.materialise(weights.select("query_id", F.lit(3).cast("long").alias("doc_id")).distinct(), "pairs")
        plan = P._pair_sums(pairs, weights, index.forward, index.avgdl)._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
        routes, _ = P._chosen_blocks(P.materialise(P._places(weights, index, F.lit(1.0)), "places"), index, pairs.select("query_id", F.lit(0.0).alias("threshold")).limit(0), F.lit(1.0))
        sent = routes._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in sent or "leftHint=(strategy=broadcast)" in sent
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name, value in (("JOINED", 2), ("DIRECT", 0), ("DEAR", 0.0)):
        monkeypatch.setattr(P, name, value)
    assert found(P.search(asked, index, 5)) == want


def test_postings_travel_packed(spark, monkeypatch):
    """Rows of the shuffle of postings grow with chunks and shards, not with postings; blocks hold each posting once, whatever is held."""
    docs = library(300, 14)
    index = P.create(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    postings = {(w, r.doc_id): (tf, r.dl) for r in index.forward.collect() for w, tf in zip(r.words, r.tfs)}
    assert P._pieces(index.forward, index.avgdl, 7).count() <= 7 * index.forward.rdd.getNumPartitions() < len(postings) / 10
    for chunk, shard, most, spread in ((1 << 20, 1 << 19, 1 << 21, 64), (50, 20, 30, 3)):
        for name, value in (("CHUNK", chunk), ("SHARD", shard), ("MOST", most), ("SPREAD", spread)):
            monkeypatch.setattr(P, name, value)
        rows = P._block_rows(index.forward, index.avgdl, len(postings)).collect()
        got = [((r.term, i), (tf, dl)) for r in rows for i, tf, dl in zip(r.ids, r.tfs, r.dls)]
        assert len(got) == len(postings) and dict(got) == postings
        assert all(r.n == len(r.ids) <= P.BLOCK and r.max_tf == max(r.tfs) and r.min_dl == min(r.dls) for r in rows)


def test_keys_of_texts_are_numbers_in_the_order_of_their_digests(spark):
    texts = [f"text number {i % 70}" for i in range(100)]
    docs = spark.createDataFrame([*enumerate(texts), (200, None)], "doc_id long, text string").repartition(5)
    index = RT.text_index(docs)
    rank = {t: i for i, t in enumerate(sorted(set(texts), key=lambda t: hashlib.md5(t.encode()).hexdigest()))}
    assert {r.doc_id: r.content_key for r in index.members.collect()} == {i: rank[t] for i, t in enumerate(texts)} | {200: None}
    assert index.members.schema["content_key"].dataType.simpleString() == "int" == index.postings.forward.schema["doc_id"].dataType.simpleString()
