"""Registered queries of the numbered operators and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.llm import (
    ann, bpe, collocations, exact_dedup, html_extract, langid, line_dedup, lm, mixing, simhash, suffix_dedup, url_filter,
    whitening,
)
from deskspark.llm.common import table
from deskspark.session import ship

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def register(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern of its tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@register("op1_ann_search")
def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


@register("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@register("op3_mix_sources", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ((('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1)::BIGINT AS pos FROM s),
w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    source_size * 2.0::DOUBLE AS most FROM n),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
v AS (SELECT arg_min(level, pos2) AS level FROM (
  SELECT level, row_number() OVER (ORDER BY most / weight, pos) AS pos2, most, weight FROM l) WHERE level <= most / weight),
t AS (
  SELECT l.source, l.source_size, CASE WHEN v.level IS NULL THEN most ELSE least(most, weight * v.level) END AS target
  FROM l, v),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, floor(rate) AS whole, CASE WHEN size = 0 THEN 0 ELSE rate - floor(rate) END AS p,
    target - floor(rate) * source_size AS rest FROM r),
z AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM p),
run AS (
  SELECT *, CASE WHEN odds IS NOT NULL THEN sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY odds NULLS LAST, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS run
  FROM z)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN run IS NULL THEN 0
    WHEN run <= rest OR (run - rest < rest - (run - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run""")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@register("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return bpe.encode(table(spark, sf_dir, "documents"), path, pattern, keep_ids=False)


@register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, the dropped ones and the digest of what is left."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op6_simhash_dedup")
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, *lm.fit(docs))


@register("op8_exact_dedup", """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (
  SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id,
    count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"), digest=True)


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


@register("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, model).drop("url")


@register("op11_collocations", r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (
  SELECT lang, unnest(ws) AS w1, unnest(ws[2:] || [NULL]) AS w2, unnest(ws[3:] || [NULL, NULL]) AS w3,
    unnest(ws[4:] || [NULL, NULL, NULL]) AS w4 FROM w WHERE len(ws) > 0),
g AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS ph, count(*) AS f FROM i WHERE w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM i WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM i WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM i WHERE w4 IS NOT NULL GROUP BY ALL
    HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM i WHERE w1 IS NOT NULL GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(ph, ' ') AS ws FROM g WHERE k > 1),
x AS MATERIALIZED (
  SELECT lang, ph, k, f, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT x.lang, x.ph, x.f AS a, x.j, l.f AS l, r.f AS r, (2000000::HUGEINT * x.f) // (l.f + r.f) AS score
  FROM x JOIN g AS l ON l.lang = x.lang AND l.ph = x.head JOIN g AS r ON r.lang = x.lang AND r.ph = x.tail),
b AS (SELECT lang, ph, a, min({'score': score, 'j': j, 'l': l, 'r': r}) AS cut FROM s GROUP BY lang, ph, a),
o AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS ph, max(f) AS longest
  FROM (SELECT *, unnest([1, 2, 1, 2, 3]) AS i, unnest([2, 2, 3, 3, 2]) AS m FROM c)
  WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
q AS (
  SELECT b.lang, b.ph AS phrase, b.a, cut.l AS l, cut.r AS r, cut.score::BIGINT AS score
  FROM b LEFT JOIN o ON b.lang = o.lang AND b.ph = o.ph WHERE o.longest IS NULL OR 100 * o.longest < 80 * b.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM q)
SELECT t.lang, t.rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE t.rank <= 2000""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


@register("op12_html_extract")
def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.learn(html_extract.labelled_pages())
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, model).withColumn("n_chars", F.length("text").cast("long"))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))  # beyond a long: null
