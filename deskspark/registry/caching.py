"""Reply-cache queries: documents as mails and, with their first 500 characters, as entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskspark.functions import text as X
from deskspark.operators import cache as I
from deskspark.registry import register
from deskspark.registry.views import mails, sql_strip, table, with_ctes
from deskspark.session import shared_dir
from deskspark.sinks import counted

AS_OF = "2024-01-08 02:00:00"
KEY_SQL = "md5(" + sql_strip(
    r"regexp_replace(lower({c} || ':' || {s} || ':' || substr({b}, 1, 500)), '\s+', ' ', 'g')") + ")"
REQ_SQL = with_ctes("mails") + """, req AS (
  SELECT id, doc_id, lang AS category, subject, body, received_at AS ts, 'Answer ' || id AS response,
    CAST(doc_id % 11 AS DOUBLE) AS qa_score FROM mails)
"""
CACHE_SQL = REQ_SQL + f""", keyed AS (SELECT *, {KEY_SQL.format(c='category', s='subject', b='body')} AS cache_key FROM req),
cache AS (SELECT cache_key, subject, substr(body, 1, 500) AS body, category, response, qa_score, ts, inserted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, response DESC) AS rn,
    min(ts) OVER (PARTITION BY cache_key) AS inserted_at FROM keyed) WHERE rn = 1),
live AS (SELECT * FROM cache WHERE NOT (TIMESTAMP '{AS_OF}' - ts > INTERVAL 168 HOURS))
"""


def requests(spark, sf_dir):
    return mails(spark, sf_dir).select(
        "id", "doc_id", F.col("lang").alias("category"), "subject", "body", F.col("received_at").alias("ts"),
        F.concat(F.lit("Answer "), F.col("id")).alias("response"), (F.col("doc_id") % 11).cast("double").alias("qa_score"),
    )


def cache_table(spark, sf_dir):
    rows = I.cache_rows(requests(spark, sf_dir))
    return I.upsert(rows.limit(0), rows)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@register("content_key", REQ_SQL + f"SELECT id, {KEY_SQL.format(c='category', s='subject', b='body')} AS cache_key FROM req")
def content_key(spark, sf_dir):
    return requests(spark, sf_dir).select(
        "id", X.content_key(F.col("category"), F.col("subject"), F.col("body")).alias("cache_key"))


@register("ttl_filter", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts FROM events)
SELECT event_id, coalesce(TIMESTAMP '2024-01-20 00:00:00' - TRY_CAST(ts AS TIMESTAMP) > INTERVAL 168 HOURS, true) AS expired FROM e""")
def ttl_filter(spark, sf_dir):
    text = F.when(F.col("event_id") % 8 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    ts = F.try_to_timestamp(text).cast("timestamp_ntz")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", I.expired(ts, now).alias("expired"))


@register("jaccard_pairs", r"""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS words FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.words, b.words)) / CAST(len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)) AS DOUBLE), 9) AS jaccard,
  len(list_intersect(a.words, b.words)) / CAST(len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)) AS DOUBLE) >= 0.1 AS similar
FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 2 WHERE len(a.words) > 0 AND len(b.words) > 0""")
def jaccard_pairs(spark, sf_dir):
    """Each message against the one two turns before it (the same speaker)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.word_set(F.col("text")).alias("words"))
    earlier = c.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("words").alias("earlier"))
    j = X.jaccard(F.col("words"), F.col("earlier"))
    return c.join(earlier, ["conv_id", "turn"]).filter(j.isNotNull()).select(
        "conv_id", "turn", F.round(j, 9).alias("jaccard"), (j >= 0.1).alias("similar"))


@register("cache_upsert", CACHE_SQL + "SELECT cache_key, response, qa_score, ts, inserted_at, len(body) AS body_chars FROM cache")
def cache_upsert(spark, sf_dir):
    return cache_table(spark, sf_dir).select(
        "cache_key", "response", "qa_score", "ts", "inserted_at", F.length("body").cast("bigint").alias("body_chars"))


@register("cache_exact", CACHE_SQL + """
SELECT k.id, k.cache_key, live.response AS cached_response, 'exact' AS hit_type FROM keyed k JOIN live USING (cache_key)""")
def cache_exact(spark, sf_dir):
    m = requests(spark, sf_dir).select("id", "category", "subject", "body")
    hits = I.exact_hits(m, cache_table(spark, sf_dir), as_of())
    return hits.select("id", "cache_key", F.col("response").alias("cached_response"), "hit_type")


@register("cache_fuzzy", CACHE_SQL + r"""
, q AS (SELECT id, category, ts, list_distinct(list_filter(regexp_split_to_array(lower(subject || ' ' || body), '\s+'), lambda x: x <> '')) AS w FROM req),
e AS (SELECT cache_key, category, inserted_at, list_distinct(list_filter(regexp_split_to_array(lower(subject || ' ' || body), '\s+'), lambda x: x <> '')) AS w FROM live),
qt AS (SELECT id, category, len(w) AS n, unnest(w) AS t FROM q WHERE len(w) * 0.8 <= (SELECT max(len(w)) FROM e)),
et AS (SELECT cache_key, category, inserted_at, len(w) AS n, unnest(w) AS t FROM e),
p AS (SELECT id, cache_key, inserted_at, qt.n AS qn, et.n AS en, count(*) AS shared FROM qt JOIN et
      ON qt.category = et.category AND qt.t = et.t AND least(qt.n, et.n) >= 0.79 * greatest(qt.n, et.n) GROUP BY ALL),
m AS (SELECT id, arg_min(cache_key, (inserted_at, cache_key)) AS cache_key, min(inserted_at) AS inserted_at FROM p
      WHERE shared / CAST(qn + en - shared AS DOUBLE) >= 0.8 GROUP BY id)
SELECT m.id, m.cache_key, m.inserted_at FROM m JOIN req USING (id) WHERE m.inserted_at < req.ts""")
def cache_fuzzy(spark, sf_dir):
    """Earliest similar entry that was stored before the mail came in."""
    req = requests(spark, sf_dir)
    hits = I.fuzzy_hits(req.select("id", "category", "subject", "body"), cache_table(spark, sf_dir), as_of())
    return hits.join(req.select("id", "ts"), "id").filter("inserted_at < ts").select("id", "cache_key", "inserted_at")


@register("cache_purge", CACHE_SQL + "SELECT cache_key, ts FROM live")
def cache_purge(spark, sf_dir):
    return I.unexpired(cache_table(spark, sf_dir), as_of()).select("cache_key", "ts")


@register("purge_counts", CACHE_SQL + """
SELECT (SELECT count(*) FROM cache) AS before, (SELECT count(*) FROM live) AS after, (SELECT count(*) FROM cache) - (SELECT count(*) FROM live) AS removed""")
def purge_counts(spark, sf_dir):
    """The purge as a write, with the entry counts it gives without another pass."""
    got = counted.purge(cache_table(spark, sf_dir), as_of(), f"{shared_dir(spark)}/live")
    return spark.createDataFrame([(got["before"], got["after"], got["removed"])], "before long, after long, removed long")


@register("cache_stats", CACHE_SQL + f"""
, g AS (SELECT category, TIMESTAMP '{AS_OF}' - ts > INTERVAL 168 HOURS AS gone FROM cache)
SELECT category, count(*) AS total_entries, count(*) FILTER (WHERE NOT gone) AS active_entries, count(*) FILTER (WHERE gone) AS expired_entries
FROM g GROUP BY GROUPING SETS ((), (category))""")
def cache_stats(spark, sf_dir):
    return I.statistics(cache_table(spark, sf_dir), as_of())


@register("cache_gate", CACHE_SQL + """
SELECT k.id, live.response AS cached_response, live.qa_score FROM keyed k JOIN live USING (cache_key)
WHERE k.doc_id % 3 = 0 AND live.qa_score >= 7""")
def cache_gate(spark, sf_dir):
    m = requests(spark, sf_dir).select("id", "category", "subject", "body", (F.col("doc_id") % 3).alias("attempt"))
    hits = I.exact_hits(m, cache_table(spark, sf_dir), as_of())
    return I.reuse_gate(hits, F.col("attempt")).select("id", F.col("response").alias("cached_response"), "qa_score")


@register("dedup_content", "SELECT lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lang, md5(text)")
def dedup_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "source", "text")
    return I.dedup_content(d, ["lang"], "text", "doc_id").select("lang", "doc_id", "source")
