"""Search, fusion, re-ranking, compression and context building."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from deskspark import rules as R
from deskspark.functions import text as X
from deskspark.operators import postings as P
from deskspark.operators import vectors as V
from deskspark.session import materialise
from deskspark.settings import DEFAULTS, Settings


DIGITS = 9
#: (query_id, text) rows to (query_id, vector); rows without a vector may be left out.
Encoder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class TextIndex:
    """A document set for keyword and hybrid search, equal texts as one: `members` (doc_id, content_key) and the
    postings of the distinct texts by content_key, counted as often as they occur. Keys are numbers from 0 in the order of the
    digests of the texts; null texts have none."""

    members: DataFrame
    postings: P.PostingIndex


def _numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with their place in the order of a column, written to the shared folder; ints where they do."""
    ordered = rows.repartitionByRange(column).sortWithinPartitions(column)
    placed = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), name, free=True)
    part = F.shiftright("_at", 33)  # partition above, row below
    sizes = {r.part: r.n for r in placed.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).collect()}
    starts = [sum(sizes.get(i, 0) for i in range(p)) for p in range(max(sizes, default=0) + 1)]
    number = F.get(F.lit(starts).cast("array<long>"), part.cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, number.cast("int" if sum(sizes.values()) < 1 << 31 else "long")).drop("_at")


def text_index(docs: DataFrame, path: str | None = None) -> TextIndex:
    """Index of (doc_id, text). Of equal texts one is tokenised, found by ids and keys alone."""
    digest = F.unhex(F.md5("text")).alias("digest")
    digests = materialise(docs.select("doc_id", digest), "digests")
    one = digests.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    texts = _numbered(one, "digest", "content_key")
    members = materialise(digests.join(texts.select("digest", "content_key"), "digest", "left").select("doc_id", "content_key"), "members", free=True)
    keyed = docs.select("doc_id", "text", digest).join(texts, ["doc_id", "digest"])
    return TextIndex(members, P.create(keyed.select(F.col("content_key").alias("doc_id"), "text", "copies"), path))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (1.0 + distance)


def max_normalised(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores divided by the best of their query; a best of 0 or less divides by 1."""
    best = scores.groupBy("query_id").agg(F.max(column).alias("_max"))
    top = F.when(F.col("_max") > 0, F.col("_max")).otherwise(1.0)
    return scores.join(best, "query_id").withColumn(column, F.col(column) / top).drop("_max")


def fuse(semantic: DataFrame, keyword: DataFrame, alpha: float) -> DataFrame:
    """Weighted full outer merge of (query_id, doc_id, semantic) and (query_id, doc_id, keyword)."""
    both = semantic.join(keyword, ["query_id", "doc_id"], "full")
    s, kw = F.coalesce("semantic", F.lit(0.0)), F.coalesce("keyword", F.lit(0.0))
    return both.select("query_id", "doc_id", (alpha * s + (1 - alpha) * kw).alias("fused"))


def hybrid_search(
    queries: DataFrame, vectors: V.VectorIndex, index: TextIndex | None, k: int = 4, alpha: float = 0.5,
) -> DataFrame:
    """Vector and keyword search fused per query: (query_id, doc_id, score, rank).

    queries (query_id, text, vector), from stored vectors and a stored text index; no text of a document is read. Texts
    are what is ranked: equal texts are one candidate, with the largest distance among its vector
    hits and the nearest of them as its document. After the cut to k only candidates with a
    vector hit stay, so fewer than k rows may come back. `score` is 1 - fused.

    Without an index it is the vector search alone, and `score` the distance.

    Every text has a keyword score, but only the 3k best can take one of the k places from the 2k
    vector hits, so nothing else is scored. Both hit lists and the result are small tables; written out,
    their true size lets Spark choose how to join them, also with the texts.
    """
    if index is None:
        return V.search(queries, vectors, k).withColumnRenamed("distance", "score")
    near = materialise(V.search(queries, vectors, 2 * k), "near")
    hits = near.join(index.members, "doc_id")
    semantic = hits.groupBy("query_id", "content_key").agg(
        F.max("distance").alias("distance"),
        F.min(F.struct("distance", "doc_id"))["doc_id"].alias("hit_id"),
    )
    semantic = materialise(semantic, "semantic")
    best = P.search(queries, index.postings, 3 * k)
    named = P.pair_scores(semantic.select("query_id", F.col("content_key").alias("doc_id")), queries, index.postings)
    keyword = best.select("query_id", "doc_id", "score").unionByName(named) \
        .groupBy("query_id", F.col("doc_id").alias("content_key")).agg(F.max("score").alias("score"))
    keyword = materialise(keyword, "keyword")
    both = semantic.join(max_normalised(keyword), ["query_id", "content_key"], "full")
    sem = F.coalesce(similarity(F.col("distance")), F.lit(0.0))
    kw = F.coalesce("score", F.lit(0.0))
    fused = both.select(
        "query_id", "content_key", "hit_id", F.round(kw, DIGITS).alias("kw"),
        F.round(alpha * sem + (1 - alpha) * kw, DIGITS).alias("fused"))
    w = W.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("kw"), "content_key")
    ranked = fused.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    again = W.partitionBy("query_id").orderBy("place")
    return materialise(ranked.filter("hit_id IS NOT NULL").select(
        "query_id", F.col("hit_id").alias("doc_id"), F.round(1 - F.col("fused"), DIGITS).alias("score"),
        F.row_number().over(again).alias("rank")), "hybrid")


def reciprocal_rank_fusion(lists: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Fuse (query_id, list_id, doc_id, content_key, rank) rows: sum of 1/(k + rank) per text.

    A text is stood for by its first-seen document; equal scores keep first-seen order.
    """
    seen = F.struct("list_id", "rank")
    fused = lists.groupBy("query_id", "content_key").agg(
        F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), DIGITS).alias("score"),
        F.min(seen).alias("first_seen"), F.min_by("doc_id", seen).alias("doc_id"),
    )
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "first_seen", "doc_id")
    return fused.select("query_id", "doc_id", "score", F.row_number().over(w).alias("rank"))


def coverage(query: Column, text: Column) -> Column:
    """Share of distinct query words that occur in the text."""
    def share(q: Column) -> Column:
        shared = F.size(F.array_intersect(q, X.word_set(text)))
        return F.when(F.size(q) > 0, shared / F.size(q)).otherwise(0.0)

    return X.let(X.word_set(query), share)


def rerank(
    candidates: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = coverage,
    keep: int | None = None,
) -> DataFrame:
    """Re-order (query_id, doc_id, query, text, rank, score) by a pair scorer, best first.

    Cut to `keep` rows, k by default.

    Queries with at most k candidates keep order and score; others get score 1 - pair score.
    `scorer` is any column function of (query, text): built-in columns or a pandas UDF. Candidates
    per query are few (a multiple of k), so counting them per query is cheap.
    """
    sized = candidates.withColumns({
        "_n": F.count("*").over(W.partitionBy("query_id")),
        "_s": F.round(scorer(F.col("query"), F.col("text")), DIGITS),
    })
    many = F.col("_n") > k
    w = W.partitionBy("query_id").orderBy(F.desc(F.when(many, F.col("_s"))), "rank")
    return (
        sized.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= (keep or k))
        .withColumns({
            "score": F.when(many, F.round(1 - F.col("_s"), DIGITS)).otherwise(F.col("score")),
            "rank": F.col("_place"),
        }).drop("_n", "_s", "_place")
    )


def rerank_or_keep(
    candidates: DataFrame, k: int, scorer: Callable[[Column, Column], Column], keep: int | None = None,
) -> DataFrame:
    """As rerank, with a scorer that gives (value, error) structs (functions.isolation): a query with a pair that failed keeps its
    first rows in their order with their scores. Adds error_message, the first failure of the query."""
    scored = candidates.withColumn("_r", scorer(F.col("query"), F.col("text")))
    failed = scored.withColumn("error_message", F.min("_r.error").over(W.partitionBy("query_id")))
    whole = rerank(failed.where("error_message IS NULL").withColumn("_v", F.col("_r.value")), k, lambda q, t: F.col("_v"), keep)
    rest = failed.where("error_message IS NOT NULL AND rank <= " + str(keep or k))
    return whole.drop("_r", "_v").unionByName(rest.drop("_r"))


def cleaned_lines(text: Column) -> Column:
    """Lines of a model's list answer: trimmed, longer than 10 characters, numbering removed."""
    lines = F.transform(F.split(text, "\n"), X.strip)
    kept = F.filter(lines, lambda ln: F.length(ln) > 10)
    return F.transform(kept, lambda ln: F.regexp_replace(ln, R.LIST_NUMBER, ""))


def query_variants(query: Column, variants: Column, n: int = 3) -> Column:
    """The query itself and up to n variants; very short queries stay alone."""
    extra = F.slice(cleaned_lines(F.coalesce(variants, F.lit(""))), 1, n)
    own = F.array(query)
    return F.when(X.word_count(query) < 3, own).otherwise(F.concat(own, extra))


def is_complex(query: Column) -> Column:
    return X.holds_any(query, R.COMPLEX_MARKS) & (X.word_count(query) > 10)


def sub_queries(query: Column, parts: Column) -> Column:
    """Up to three supplied parts of a complex query, else the query itself."""
    lines = F.slice(cleaned_lines(F.coalesce(parts, F.lit(""))), 1, 3)
    return F.when(is_complex(query) & (F.size(lines) > 0), lines).otherwise(F.array(query))


def accepted_rewrite(query: Column, rewrite: Column) -> Column:
    """The supplied rewrite when the query is not clear already and its length is plausible."""
    clear = (X.word_count(query) > 8) & F.contains(query, F.lit("?"))
    tidy = X.strip(rewrite)
    usable = (F.length(tidy) > 10) & (F.length(tidy) < 200)
    return F.when(~clear & F.coalesce(usable, F.lit(False)), tidy).otherwise(query)


def compress(query: Column, content: Column, n: int = 3) -> Column:
    """Struct (content, compressed): the n sentences that cover most query words, in text order.

    Chosen by text, so any copy of a chosen sentence qualifies before the cut to n.
    """
    def shortened(parts: Column, words: Column) -> Column:
        def scored(s: Column, i: Column) -> Column:
            shared = F.size(F.array_intersect(words, X.word_set(s)))
            return F.struct((-shared).alias("s"), i.alias("pos"), s.alias("text"))

        best = F.slice(F.array_sort(F.transform(parts, scored)), 1, n)
        kept = X.let(F.transform(best, lambda b: b["text"]), lambda chosen: F.filter(
            parts, lambda s: F.array_contains(chosen, s)))
        return F.array_join(F.slice(kept, 1, n), " ")

    def shape(parts: Column) -> Column:
        long = F.size(parts) > n
        return F.struct(
            F.when(long, X.let(X.word_set(query), lambda words: shortened(parts, words)))
            .otherwise(content).alias("content"),
            long.alias("compressed"),
        )

    return X.let(X.sentences(content), shape)


def context_text(docs: DataFrame, key: str = "id", gap: str = "\n\n---\n\n") -> DataFrame:
    """One context text per key from its ranked (source, content) rows; a few rows per key."""
    part = F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("Unknown")), F.lit("]\n"), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return docs.groupBy(key).agg(rows.alias("_rows")).select(
        key, F.array_join(F.transform("_rows", lambda r: r["part"]), gap).alias("context"))


def context_or_none(context: Column) -> Column:
    return F.coalesce(context, F.lit(R.NO_CONTEXT))


def retrieval_summary(docs: DataFrame, key: str = "id") -> DataFrame:
    """Number of documents and their sources in rank order, per key."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "source")))
    return docs.groupBy(key).agg(F.count("*").alias("docs_retrieved"), rows.alias("_rows")).select(
        key, "docs_retrieved", F.transform("_rows", lambda r: r["source"]).alias("sources"))


def encoded(search: DataFrame, encoder: Encoder | None) -> DataFrame:
    """(query_id, text, vector) of what is searched: its own vectors, or those of the encoder for the text as it is now."""
    if encoder is None:
        return search.select("query_id", "text", "vector")
    texts = materialise(search.select("query_id", "text"), "searched_texts")
    return materialise(texts.join(encoder(texts), "query_id", "left"), "searched")


def standard_retrieval(
    queries: DataFrame, docs: DataFrame, vectors: V.VectorIndex, index: TextIndex | None, k: int,
    settings: Settings = DEFAULTS, encoder: Encoder | None = None,
) -> DataFrame:
    """Rewrite, hybrid search with over-fetch, re-rank, cut, compress.

    queries (query_id, text, vector[, rewrite]). Returns (query_id, rank, doc_id, score, content,
    compressed). With an encoder, the one of the stored vectors, an accepted rewrite is searched by its own
    vector and queries need none.
    """
    if settings.use_rewrite and "rewrite" in queries.columns:
        asked = queries.withColumn("search", accepted_rewrite(F.col("text"), F.col("rewrite")))
    else:
        asked = queries.withColumn("search", F.col("text"))
    search = encoded(asked.withColumn("text", F.col("search")), encoder)
    fetch = 3 * k if settings.use_rerank else k
    if settings.use_hybrid:
        found = hybrid_search(search, vectors, index, fetch, settings.alpha)
    else:
        found = hybrid_search(search, vectors, None, fetch)
    rows = found.join(docs.select("doc_id", "text"), "doc_id").join(
        asked.select("query_id", F.col("text").alias("asked"), F.col("search").alias("query")), "query_id")
    if settings.use_rerank:
        rows = rerank(rows, k)
    rows = rows.filter(F.col("rank") <= k)
    return _compressed(rows, settings).select("query_id", "rank", "doc_id", "score", "content", "compressed")


def _compressed(rows: DataFrame, settings: Settings) -> DataFrame:
    if settings.use_compression:
        shape = compress(F.col("asked"), F.col("text"), settings.keep_sentences)
    else:
        shape = F.struct(F.col("text").alias("content"), F.lit(False).alias("compressed"))
    return rows.withColumn("_c", shape).select("*", "_c.*")


def advanced_retrieval(
    queries: DataFrame, docs: DataFrame, vectors: V.VectorIndex, index: TextIndex | None, k: int,
    settings: Settings = DEFAULTS, encoder: Encoder | None = None,
) -> DataFrame:
    """Decompose, vary, search each variant, fuse by rank, re-rank, compress, cut.

    queries (query_id, text, vector, parts, variants): one search over all variants of all queries,
    keyed (query, variant). Same result columns as the standard mode. With an encoder every variant is searched by
    its own vector and queries need none; without one all variants of a query share its vector.
    """
    own = ["vector"] if encoder is None else []
    subs = queries.withColumn("_subs", sub_queries(F.col("text"), F.col("parts")))
    subs = subs.select("query_id", *own, "variants", F.posexplode("_subs").alias("sub_no", "sub"))
    varied = subs.withColumn("_vars", query_variants(F.col("sub"), F.col("variants"), 2))
    varied = varied.select("query_id", *own, "sub_no", F.posexplode("_vars").alias("var_no", "text"))
    list_id = F.col("sub_no") * 10 + F.col("var_no")
    keyed = varied.select(F.struct("query_id", list_id.alias("list_id")).alias("q"), "text", *own)
    search = encoded(keyed.select(F.to_json("q").alias("query_id"), "text", *own), encoder)
    found = hybrid_search(search, vectors, index, 2 * k, settings.alpha)
    q = F.from_json("query_id", keyed.schema["q"].dataType)
    lists = found.withColumn("q", q).select("q.*", "doc_id", "rank").join(
        docs.select("doc_id", F.md5("text").alias("content_key")), "doc_id")
    fused = materialise(reciprocal_rank_fusion(lists, settings.rrf_k), "fused")
    rows = fused.join(docs.select("doc_id", "text"), "doc_id").join(
        queries.select("query_id", F.col("text").alias("asked"), F.col("text").alias("query")), "query_id")
    if settings.use_rerank:
        rows = rerank(rows, k, keep=2 * k)
    rows = rows.filter(F.col("rank") <= k)
    return _compressed(rows, settings).select("query_id", "rank", "doc_id", "score", "content", "compressed")


def retrieve(
    queries: DataFrame, docs: DataFrame, vectors: V.VectorIndex, index: TextIndex | None, k: int,
    settings: Settings = DEFAULTS, encoder: Encoder | None = None,
) -> DataFrame:
    """Retrieval in the mode that the settings ask for: advanced with variants or decomposition, else standard."""
    mode = advanced_retrieval if settings.advanced else standard_retrieval
    return mode(queries, docs, vectors, index, k, settings, encoder)


def probe(queries: DataFrame, docs: DataFrame, vectors: V.VectorIndex, k: int = 2, shown: int = 150) -> DataFrame:
    """What a stored corpus answers: (query_id, rank, doc_id, distance, preview), the preview being the first characters in one line."""
    found = V.search(queries, vectors, k)
    preview = F.replace(F.substring("text", 1, shown), F.lit("\n"), F.lit(" "))
    return found.join(docs.select("doc_id", preview.alias("preview")), "doc_id").select(
        "query_id", "rank", "doc_id", "distance", "preview")


def subject_and_body_hits(hits: DataFrame) -> DataFrame:
    """Merge the top hits of each mail's subject (part 0) and body (part 1): (id, docs).

    hits (id, part, content_key, ...), at most one per part. `docs` holds them in order, equal contents
    once. One shuffle on the mail id, which a following join on the id reuses.
    """
    rest = [c for c in hits.columns if c not in ("id", "part")]
    both = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", *rest))).alias("docs"))
    first = F.get("docs", F.lit(0))["content_key"]
    once = F.filter("docs", lambda d, i: (i == 0) | (d["content_key"] != first))
    return both.select("id", once.alias("docs"))
