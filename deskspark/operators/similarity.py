"""Exact Jaccard search: for each query set, the first stored set that is similar enough.

Two sets with Jaccard >= t share a token among the first n - ceil(t*n) + 1 tokens of each, in any
common token order (prefix filtering, as published for set-similarity joins). Tokens are ordered
rarest first. Four measures keep hot groups in check:

* equal word sets are one row on either side, by partial aggregation, so a group of exact copies
  costs one comparison however large it is;
* a block (sets sharing a prefix token) is probed a few of its earliest entries at a time. As only
  the first stored match counts, queries that found one leave the later rounds of the block, so
  near copies are not compared with each other;
* the per-block limit is a rank filter, which Spark applies per map task before it shuffles;
* a set carries a sketch: of each of 256 hash buckets, whether it holds an odd number of words. Two
  sketches differ in at most as many bits as their sets in words, so a pair whose sketches differ in more
  than the threshold allows is dropped where it is met, before pairs or words are shuffled.

Rounds go on until no block holds both unprobed entries and queries they could still improve,
so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from deskspark.functions import text as X
from deskspark.session import materialise

MAX_BROADCAST_TERMS = 200_000
FIRST_ROUND = 32
GROWTH = 8
SLACK = 1e-9
#: Longs of a sketch.
LANES = 4


def set_key(words: Column) -> Column:
    return F.md5(F.array_join(F.sort_array(words), "\n"))


def _sketch(words: Column) -> Column:
    """LANES longs: of each hash bucket, whether an odd number of the words falls into it."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def lane(hs: Column, i: int) -> Column:
        def flipped(acc: Column, h: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
            return F.when(F.shiftright(h, 6).bitwiseAND(LANES - 1) == i, acc.bitwiseXOR(bit)).otherwise(acc)
        return F.aggregate(hs, F.lit(0).cast("long"), flipped)

    return X.let(hashes, lambda hs: F.struct(*[lane(hs, i).alias(f"s{i}") for i in range(LANES)]))


def _differing(a: str, b: str) -> Column:
    """Words by which two sets differ at least, of their sketches."""
    return sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(LANES)), F.lit(0))


def _prefix_size(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * threshold - SLACK) + 1


def _common_terms(entries: DataFrame) -> DataFrame:
    """Frequencies of the most common terms.

    A term kept here occurs at least total/limit times, so there are at most MAX_BROADCAST_TERMS of
    them whatever the data size; all rarer terms tie as frequency 0.
    """
    total = entries.agg(F.sum("n")).first()[0] or 0
    least = -(-total // MAX_BROADCAST_TERMS)
    terms = entries.select(F.explode("words").alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= max(least, 1))


def _prefix_postings(sets: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """(set columns, term) rows of each set's prefix; the word array is left behind."""
    keep = [c for c in sets.columns if c != "words"]
    rows = sets.select(*keep, F.explode("words").alias("term"))
    ranked = rows.join(F.broadcast(common), "term", "left")
    w = W.partitionBy("category", "set_key").orderBy(F.coalesce("df", F.lit(0)), "term")
    return (
        ranked.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= _prefix_size(F.col("n"), threshold))
        .select(*keep, "term")
    )


def first_similar(queries: DataFrame, entries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Match query sets (category, words) with entry sets (category, words, ord).

    `ord` is a struct that sorts entries by insertion. Returns (category, set_key, ord) with the
    smallest `ord` of a similar entry of the same category, one row per matched query word set.
    """
    def distinct_sets(df: DataFrame, *aggs: Column) -> DataFrame:
        keyed = df.filter(F.size("words") > 0).withColumn("set_key", set_key(F.col("words")))
        return keyed.groupBy("category", "set_key").agg(F.any_value("words").alias("words"), *aggs
                                                        ).withColumn("n", F.size("words")).withColumn("sketch", _sketch(F.col("words")))

    stored = materialise(distinct_sets(entries, F.min("ord").alias("ord")), "stored")
    # a query larger than this cannot reach the threshold with any entry, so it is not even shuffled
    longest = stored.agg(F.max("n")).first()[0] or 0
    asked = queries.filter(F.size("words") * threshold <= longest + SLACK)
    asked = materialise(distinct_sets(asked), "asked")

    common = _common_terms(stored)
    posts = materialise(_prefix_postings(stored, common, threshold), "stored_prefix")
    live = materialise(_prefix_postings(asked, common, threshold), "asked_prefix")
    block = ["category", "term"]
    size, best, number = FIRST_ROUND, None, 0
    while True:
        w = W.partitionBy(*block).orderBy("ord", "set_key")
        batch = posts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size + 1)
        batch = materialise(batch, f"batch{number}")
        found = _verified(live, batch.filter(F.col("_r") <= size), asked, stored, threshold)
        if best is not None:
            found = best.unionByName(found)
        best = materialise(
            found.groupBy("category", "set_key").agg(F.min("ord").alias("ord")), f"best{number}"
        )
        # blocks with entries left, and the first entry of each that is still to be probed
        more = batch.filter(F.col("_r") == size + 1).select(*block, F.col("ord").alias("next_ord"),
                                                            F.col("set_key").alias("next_key"))
        if more.isEmpty():
            return best
        so_far = best.select("category", "set_key", F.col("ord").alias("best_ord"))
        live = materialise(
            live.join(more, block).join(so_far, ["category", "set_key"], "left")
            .filter(F.col("best_ord").isNull() | (F.col("best_ord") > F.col("next_ord")))
            .select(*live.columns),
            f"live{number}",
        )
        if live.isEmpty():
            return best
        rest = F.struct("ord", "set_key") >= F.struct("next_ord", "next_key")
        posts = posts.join(more, block).filter(rest).select(*posts.columns)
        posts = materialise(posts, f"posts{number}")
        size, number = size * GROWTH, number + 1


def _verified(
    live: DataFrame, batch: DataFrame, asked: DataFrame, stored: DataFrame, threshold: float
) -> DataFrame:
    """Candidate pairs of one round that reach the threshold; ids first, word arrays last."""
    left = live.select("category", "term", "set_key", "n", "sketch")
    right = batch.select("category", "term", F.col("set_key").alias("entry_key"),
                         F.col("n").alias("entry_n"), F.col("sketch").alias("entry_sketch"), "ord")
    fits = F.least("n", "entry_n") + SLACK >= F.greatest("n", "entry_n") * threshold
    # shared >= t * either, so of the n + entry_n words of both at most (1 - t) / (1 + t) are in one alone
    near = _differing("sketch", "entry_sketch") <= (F.col("n") + F.col("entry_n")) * ((1 - threshold) / (1 + threshold)) + SLACK
    pairs = (
        left.join(right, ["category", "term"]).filter(fits & near)
        .select("category", "set_key", "entry_key", "ord").distinct()
    )
    # written out, few pairs are sent to the words, not the words to them
    pairs = materialise(pairs, "pairs")
    with_words = pairs.join(asked.select("category", "set_key", "words"), ["category", "set_key"]).join(
        stored.select("category", F.col("set_key").alias("entry_key"), F.col("words").alias("entry_words")),
        ["category", "entry_key"],
    )
    shared = F.size(F.array_intersect("words", "entry_words"))
    either = F.size("words") + F.size("entry_words") - shared
    return with_words.filter(shared / either >= threshold).select("category", "set_key", "ord")
