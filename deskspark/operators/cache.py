"""Reply cache as a table: keys, expiry, exact and fuzzy lookup, upsert, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions import text as X
from deskspark.operators.similarity import first_similar, set_key
from deskspark.settings import DEFAULTS, Settings


def expired(ts: Column, as_of: Column, settings: Settings = DEFAULTS) -> Column:
    """Older than the lifetime; an unreadable (NULL) time counts as expired."""
    age_limit = F.make_dt_interval(hours=F.lit(settings.ttl_hours))
    return F.coalesce(as_of - ts > age_limit, F.lit(True))


def unexpired(cache: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    return cache.filter(~expired(F.col("ts"), as_of, settings))


def cache_rows(replies: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Finished replies as cache rows: keyed, body cut to the stored length."""
    return replies.select(
        X.content_key(F.col("category"), F.col("subject"), F.col("body"), settings.stored_body_chars
                      ).alias("cache_key"),
        "subject", F.substring("body", 1, settings.stored_body_chars).alias("body"), "category",
        "response", "qa_score", "ts", F.col("ts").alias("inserted_at"),
    )


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins per key; the key keeps its first insertion time.

    A plain aggregate, combined map-side: a key written very often costs one row per task.
    """
    rest = [c for c in stored.columns if c not in ("cache_key", "inserted_at")]
    newest = F.max_by(F.struct(*rest), F.struct("ts", "response")).alias("row")
    return (
        stored.unionByName(new.select(*stored.columns)).groupBy("cache_key")
        .agg(newest, F.min("inserted_at").alias("inserted_at"))
        .select("cache_key", "row.*", "inserted_at").select(*stored.columns)
    )


def exact_hits(
    mails: DataFrame, cache: DataFrame, as_of: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Mails joined to the live entry with their content key."""
    key = X.content_key(F.col("category"), F.col("subject"), F.col("body"), settings.stored_body_chars)
    live = unexpired(cache, as_of, settings).select("cache_key", "response", "qa_score", "ts")
    return mails.withColumn("cache_key", key).join(live, "cache_key").withColumn("hit_type", F.lit("exact"))


def mail_words(subject: str = "subject", body: str = "body") -> Column:
    return X.word_set(F.concat_ws(" ", F.col(subject), F.col(body)))


def fuzzy_hits(
    mails: DataFrame, cache: DataFrame, as_of: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Per mail the first inserted live entry of its category that is similar enough.

    The whole mail is compared with the stored (cut) body. Returns (id, cache_key, inserted_at).
    """
    live = unexpired(cache, as_of, settings)
    entries = live.select("category", mail_words().alias("words"),
                          F.struct("inserted_at", "cache_key").alias("ord"))
    asked = mails.select("id", "category", mail_words().alias("words"))
    found = first_similar(asked.select("category", "words"), entries, settings.jaccard)
    keyed = asked.select("id", "category", set_key(F.col("words")).alias("set_key"))
    return keyed.join(found, ["category", "set_key"]).select("id", "ord.cache_key", "ord.inserted_at")


def lookup(
    mails: DataFrame, cache: DataFrame, as_of: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Exact hits, then fuzzy hits for the rest: (id, cache_key, response, qa_score, hit_type)."""
    columns = ["id", "cache_key", "response", "qa_score", "hit_type"]
    exact = exact_hits(mails, cache, as_of, settings).select(*columns)
    rest = mails.join(exact.select("id"), "id", "left_anti")
    fuzzy = fuzzy_hits(rest, cache, as_of, settings).select("id", "cache_key")
    entry = cache.select("cache_key", "response", "qa_score")
    found = fuzzy.join(entry, "cache_key").withColumn("hit_type", F.lit("fuzzy"))
    return exact.unionByName(found.select(*columns))


def reuse_gate(hits: DataFrame, attempt: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """A hit counts only on the first attempt and with a passing score."""
    return hits.filter((attempt == 0) & (F.col("qa_score") >= settings.pass_score))


def write_gate(results: DataFrame) -> DataFrame:
    """Only replies approved without revision are stored."""
    return results.filter(F.col("approved") & (F.col("revision_count") == 0))


def statistics(cache: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Entry counts overall (category NULL) and per category, in one pass."""
    gone = expired(F.col("ts"), as_of, settings)
    marked = cache.select("category", gone.cast("int").alias("gone"))
    return marked.groupingSets([[], ["category"]], "category").agg(
        F.count("*").alias("total_entries"),
        F.sum(1 - F.col("gone")).alias("active_entries"),
        F.sum("gone").alias("expired_entries"),
    )


def dedup_content(rows: DataFrame, keys: list[str], content: str, order: str) -> DataFrame:
    """Keep the first row of each content per key, by partial aggregation on its digest."""
    rest = [c for c in rows.columns if c not in keys]
    hashed = rows.withColumn("_digest", F.md5(content))
    first = F.min_by(F.struct(*rest), F.col(order)).alias("row")
    return hashed.groupBy(*keys, "_digest").agg(first).select(*keys, "row.*")
