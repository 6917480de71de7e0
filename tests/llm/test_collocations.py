"""Phrase collocations against plain counting."""

from __future__ import annotations

import collections
import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from deskspark.llm import collocations  # noqa: E402


def plain(docs, least=30, cover=80, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.ascii_lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = collections.Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i:i + k]] = max(longest[p[i:i + k]], a)
        rows = []
        for p, a in found.items():
            if longest[p] * 100 < cover * a or not longest[p]:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out |= {(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top])}
    return out


def documents(seed):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(400)]
    common = ["the", "of", "Straße", "É", "and", "x-y", "日本"]
    sure = ["new york city hall", "once upon a time", "straße der É", "the the the the the"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(0, 12)):
            k = rng.random()
            parts.append(rng.choice(sure) if k < 0.4 else rng.choice(rare) if k < 0.6 else rng.choice(common))
            parts.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r", "\x0b", "!"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), ("...", "fr"), ("THE Of the of " * 3000, "en")]


@pytest.mark.parametrize("cells, budget, chunk, top", [(None, None, None, 2000), (8, 40, 64, 5), (4, 1, 7, 12)])
def test_phrases(spark, monkeypatch, cells, budget, chunk, top):
    """Small budgets split prefixes of one and two words; small chunks cut what is added up before the shuffle."""
    if cells:
        monkeypatch.setattr(collocations, "CELLS", cells)
        monkeypatch.setattr(collocations, "BUDGET", budget)
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        monkeypatch.setattr(collocations, "FAN", 2)
    rows = documents(3)
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS word", "2 AS n", "3 AS code", "4 AS words")
    got = collocations.phrases(docs.repartition(3), top=top)
    assert [f"{n} {t}" for n, t in got.dtypes] == [
        "lang string", "rank bigint", "phrase string", "a bigint", "l bigint", "r bigint", "n bigint", "score bigint"]
    rows_got = [tuple(r) for r in got.collect()]
    assert len(rows_got) == len(set(rows_got)) and set(rows_got) == plain(rows, top=top)


def test_prefixes_above_the_budget_are_extended(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CELLS", 8)
    monkeypatch.setattr(collocations, "BUDGET", 50)
    pairs = spark.createDataFrame([(1 << 40, 5, 30), (1 << 40, 6, 90), (7, 5, 40), (9, 9, 3)], "c1 long, c2 long, n long")
    groups = collocations.partition_prefixes(pairs, 2)
    assert groups.hot.tolist() == [1 << 40] and len(groups.hot_pairs) == 1 and groups.count > 1


def test_hash_of_two_words_is_seeded_anew(spark, monkeypatch):
    seeds = []

    def once(docs, seed):
        seeds.append(seed)
        code = "1L" if seed == 0 else "xxhash64(word)"
        return docs.sparkSession.sql(f"SELECT 'en' lang, {code} code, word, 40L n FROM VALUES ('a'), ('b') AS t(word)")

    monkeypatch.setattr(collocations, "count_words", once)
    assert collocations.vocabulary(spark.range(1))[1] == 1 and seeds == [0, 1]


def test_no_documents(spark):
    assert collocations.phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.phrases(spark.createDataFrame([(None, None), ("", "en"), (". .", "en")], "text string, lang string")).count() == 0


def test_products_beyond_64_bits(spark):
    big = 6_000_000_000_000_000
    zero = ", 0L c3, 0L c4"
    counts = spark.sql(f"SELECT 1 words, 1L c1, 0L c2{zero}, {big + 3}L f UNION ALL SELECT 1, 2L, 0L{zero}, {big + 9}L "
                       f"UNION ALL SELECT 2, 1L, 2L{zero}, {big}L")
    words = spark.sql(f"SELECT 'en' lang, 1L code, 'a' word, {big + 3}L n UNION ALL SELECT 'en', 2L, 'b', {big + 9}L")
    found = counts.where("words > 1").selectExpr("struct(c1, c2, c3, c4) AS key", "words", "f")
    row = collocations.scored(found, counts, words).first()
    assert (row.phrase, row.l, row.r, row.score) == ("a b", big + 3, big + 9, 2_000_000 * big // (2 * big + 12))
