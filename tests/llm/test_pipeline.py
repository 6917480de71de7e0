"""The document pipeline against plain versions of its stages, on a small table."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import sys

import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from deskspark.llm import mixing  # noqa: E402

WORDS = {"en": "the river and stone of garden with letter music".split(), "de": "der fluss und stein im garten mit brief musik".split()}


def fingerprint(text):
    w = brute.words(text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def table():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([20, 60, 200]))), lang, rng.choice(["a", "b", None])))
    rows += [(60, rows[1][1].upper(), "en", "a"), (61, rows[1][1], None, None), (62, rows[2][1] + " stone", "en", "b"),
             (63, None, None, None), (64, "", "en", "a"), (65, "12 34 ...", "de", "a")]
    return rows


def test_pipeline(spark, tmp_path):
    rows = table()
    shape = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    text = {i: t for i, t, *_ in rows}

    known = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert known == set(text) - {63, 64, 65}  # clean documents stay
    last = {}
    for i in sorted(known):
        last[brute.ascii_lower(text[i])] = i
    left = sorted(last.values())
    fps = {i: fingerprint(text[i]) for i in left}
    root = {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for i in left:
            for j in left:
                if root[j] < root[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i], changed = root[j], True
    single = set(root.values())
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs.where(docs.doc_id.isin(*single))).collect()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter({i: n for i, n in taken.items() if n})
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in got)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_the_bit_distance(spark, tmp_path):
    rng = random.Random(17)
    big = [f"word{i}" for i in range(4000)]
    rows = []
    for i in range(20):
        base = [rng.choice(big) for _ in range(400)]
        rows.append((i, " ".join(base)))
        rows.append((100 + i, " ".join(base) + " " + rng.choice(big)))
    rows += [(200 + i, " ".join(rng.choice(big) for _ in range(400))) for i in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()}
    near = {100 + i for i in range(20) if (fingerprint(dict(rows)[i]) ^ fingerprint(dict(rows)[100 + i])).bit_count() <= 3}
    assert kept == {i for i, _ in rows} - near and len(near) > 10
