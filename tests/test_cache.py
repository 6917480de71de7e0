import random

import pytest
from pyspark.sql import functions as F

from deskspark.operators import cache as I
from deskspark.operators import similarity


def now():
    return F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")


def cache_of(spark, rows):
    df = spark.createDataFrame(rows, "category string, subject string, body string, response string, qa_score double, t string")
    return I.cache_rows(df.withColumn("ts", F.col("t").cast("timestamp_ntz")))


def test_keys_ignore_case_and_space(spark):
    rows = cache_of(spark, [("billing", "A  b", "x\n y", "r", 8.0, "2024-01-09"), ("billing", "a B", "X Y ", "r", 8.0, "2024-01-09"),
                            ("other", "a b", "x y", "r", 8.0, "2024-01-09")])
    assert rows.select("cache_key").distinct().count() == 2


def test_upsert_keeps_place_and_takes_last(spark):
    first = I.upsert(cache_of(spark, [("c", "s", "b", "old", 7.0, "2024-01-01")]), cache_of(spark, [("c", "S", "b", "new", 9.0, "2024-01-05")]))
    r = first.first()
    assert first.count() == 1 and r.response == "new" and str(r.inserted_at)[:10] == "2024-01-01"


def test_expiry(spark):
    df = spark.createDataFrame([("2024-01-03 00:00:00",), ("2024-01-02 23:59:59",), (None,)], "t string")
    got = [r[0] for r in df.select(I.expired(F.col("t").cast("timestamp_ntz"), now())).collect()]
    assert got == [False, True, True]


def test_lookup_and_gates(spark):
    words = " ".join(f"w{i}" for i in range(20))
    cache = cache_of(spark, [
        ("c", "s", words, "exact", 9.0, "2024-01-09"), ("c", "t", words + " more", "near", 6.0, "2024-01-08"),
        ("c", "gone", "old text", "old", 9.0, "2023-12-01"), ("d", "s", words, "foreign", 9.0, "2024-01-01")])
    mails = spark.createDataFrame([("1", "c", "S", words), ("2", "c", "s", words + " extra"), ("3", "c", "gone", "old text"),
                                   ("4", "e", "s", words)], "id string, category string, subject string, body string")
    got = {r.id: (r.response, r.hit_type) for r in I.lookup(mails, cache, now()).collect()}
    assert got == {"1": ("exact", "exact"), "2": ("near", "fuzzy")}      # first inserted, not the best
    hits = I.lookup(mails, cache, now())
    assert [r.id for r in I.reuse_gate(hits, F.lit(0)).collect()] == ["1"]
    assert I.reuse_gate(hits, F.lit(1)).count() == 0


def test_statistics(spark):
    cache = cache_of(spark, [("c", "1", "x", "r", 1.0, "2024-01-09"), ("c", "2", "x", "r", 1.0, "2023-01-09"), ("d", "3", "x", "r", 1.0, "2024-01-09")])
    got = {r.category: (r.total_entries, r.active_entries, r.expired_entries) for r in I.statistics(cache, now()).collect()}
    assert got == {None: (3, 2, 1), "c": (2, 1, 1), "d": (1, 1, 0)}


def brute(queries, entries, t):
    out = {}
    for cat, q in queries:
        hits = [o for c, e, o in entries if c == cat and e and q and len(q & e) / len(q | e) >= t]
        if hits:
            out[(cat, frozenset(q))] = min(hits)
    return out


@pytest.mark.parametrize("first,growth", [(1, 2), (3, 4), (32, 8)])
def test_first_similar_is_exact(spark, monkeypatch, first, growth):
    """Random sets plus a hot group of exact and near copies that holds a third of the rows."""
    monkeypatch.setattr(similarity, "FIRST_ROUND", first)
    monkeypatch.setattr(similarity, "GROWTH", growth)
    rnd = random.Random(first)
    vocab = [f"t{i}" for i in range(60)]
    hot = set(vocab[:20])

    def some(n):
        for i in range(n):
            if i % 3 == 0:
                yield "x", (hot - {rnd.choice(vocab[:20])}) | ({f"u{rnd.randrange(40)}"} if i % 2 else set())
            else:
                yield rnd.choice("xy"), set(rnd.sample(vocab, rnd.randint(1, 12)))

    entries = [(c, w, i) for i, (c, w) in enumerate(some(150))]
    queries = list(some(150)) + [("x", hot)]
    e = spark.createDataFrame([(c, sorted(w), i) for c, w, i in entries], "category string, words array<string>, i int")
    q = spark.createDataFrame([(c, sorted(w)) for c, w in queries], "category string, words array<string>")
    found = similarity.first_similar(q, e.withColumn("ord", F.struct("i")), 0.8)
    keyed = q.withColumn("set_key", similarity.set_key(F.col("words"))).join(found, ["category", "set_key"])
    got = {(r.category, frozenset(r.words)): r.ord.i for r in keyed.collect()}
    assert got == brute(queries, entries, 0.8)


def test_no_entries(spark):
    e = spark.createDataFrame([], "category string, words array<string>, i int").withColumn("ord", F.struct("i"))
    q = spark.createDataFrame([("x", ["a"])], "category string, words array<string>")
    assert similarity.first_similar(q, e).count() == 0


def test_dedup_content(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "x"), ("a", 3, "y"), ("b", 9, "x")], "k string, pos int, t string")
    got = sorted(tuple(r) for r in I.dedup_content(df, ["k"], "t", "pos").collect())
    assert got == [("a", 1, "x"), ("a", 3, "y"), ("b", 9, "x")]


def test_unlike_sets_are_dropped_before_they_are_shuffled(spark, monkeypatch):
    """Sets that share their rarest word and little else make no pairs."""
    made, write = {}, similarity.materialise

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(similarity, "materialise", counted)
    rnd = random.Random(5)
    sets = [sorted({"a", *(f"{side}{rnd.randrange(400)}" for _ in range(30))}) for side in "pq" for _ in range(60)]
    rows = [("x", w, i) for i, w in enumerate(sets)]
    e = spark.createDataFrame([*rows, ("x", sorted(f"w{i}" for i in range(20)), 500)], "category string, words array<string>, i int")
    q = spark.createDataFrame([("x", sorted({*w, "extra"})) for w in sets[:20]], "category string, words array<string>")
    found = similarity.first_similar(q, e.withColumn("ord", F.struct("i")), 0.8)
    assert sorted(r.ord.i for r in found.collect()) == list(range(20))
    assert made["pairs"] < 60
