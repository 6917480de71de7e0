"""Document chunking and keyword-index queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark import sql_access
from deskspark.functions import text as X
from deskspark.operators import chunking as E
from deskspark.operators import index as IX
from deskspark.operators import postings as P
from deskspark.registry import register
from deskspark.registry.views import any_contains, sql_strip, table
from deskspark.settings import DEFAULTS

# Markdown derived from each document: every text line opens a level-2 section named after its first
# word; a fence, a level-4 header and a second level-1 header follow.
MD_SQL = r"""WITH md AS (
  SELECT CAST(doc_id AS VARCHAR) AS source, '# ' || source || chr(10) || chr(10)
    || regexp_replace(text, '(^|\n)(\S+) ', '\1## \2' || chr(10) || '\2  ' || chr(10) || chr(10), 'g')
    || chr(10) || '### ' || lang || chr(10) || '```' || chr(10) || '# not a header' || chr(10) || chr(10) || 'code' || chr(10) || '```'
    || chr(10) || '#### deep' || chr(10) || 'tail' || chr(10) || '# End' || chr(10) || 'bye' AS text FROM documents)
"""


def markdown(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sections = F.regexp_replace("text", r"(^|\n)(\S+) ", "$1## $2\n$2  \n\n")
    text = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\n"), sections, F.lit("\n### "), F.col("lang"),
        F.lit("\n```\n# not a header\n\ncode\n```\n#### deep\ntail\n# End\nbye"))
    return d.select(F.col("doc_id").cast("string").alias("source"), text.alias("text"))


SECTIONS_SQL = MD_SQL + r""", l0 AS (SELECT source, string_split(text, chr(10)) AS arr FROM md),
l1 AS (SELECT source, unnest(range(len(arr))) AS pos, """ + sql_strip("unnest(arr)") + r""" AS line FROM l0),
l2 AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER w AS fences FROM l1
       WINDOW w AS (PARTITION BY source ORDER BY pos)),
l3 AS (SELECT *, fences % 2 = 1 AS code, CASE WHEN fences % 2 = 0 AND regexp_matches(line, '^#{1,3}( |$)')
         THEN len(regexp_extract(line, '^(#{1,3})', 1)) END AS lvl FROM l2),
l4 AS (SELECT *, max(CASE WHEN lvl = 1 THEN pos END) OVER w AS p1, max(CASE WHEN lvl = 2 THEN pos END) OVER w AS p2,
         max(CASE WHEN lvl = 3 THEN pos END) OVER w AS p3,
         sum(CASE WHEN lvl IS NOT NULL OR (NOT code AND line = '') THEN 1 ELSE 0 END) OVER w AS para
       FROM l3 WINDOW w AS (PARTITION BY source ORDER BY pos)),
l5 AS (SELECT a.source, a.pos, a.para, a.line, """ + sql_strip("substr(h1.line, 2)") + r""" AS header_1,
         CASE WHEN a.p2 > coalesce(a.p1, -1) THEN """ + sql_strip("substr(h2.line, 3)") + r""" END AS header_2,
         CASE WHEN a.p3 > greatest(coalesce(a.p1, -1), coalesce(a.p2, -1)) THEN """ + sql_strip("substr(h3.line, 4)") + r""" END AS header_3
       FROM l4 a LEFT JOIN l1 h1 ON h1.source = a.source AND h1.pos = a.p1
       LEFT JOIN l1 h2 ON h2.source = a.source AND h2.pos = a.p2 LEFT JOIN l1 h3 ON h3.source = a.source AND h3.pos = a.p3
       WHERE a.lvl IS NULL AND NOT (NOT a.code AND a.line = '')),
l6 AS (SELECT *, coalesce(header_1, '~') || '|' || coalesce(header_2, '~') || '|' || coalesce(header_3, '~') AS path FROM l5),
l7 AS (SELECT *, CASE WHEN path = lag(path) OVER w THEN 0 ELSE 1 END AS opens, lag(para) OVER w AS pp FROM l6
       WINDOW w AS (PARTITION BY source ORDER BY pos)),
l8 AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY pos) AS section FROM l7),
sections AS (SELECT source, CAST(section AS BIGINT) AS section, any_value(header_1) AS header_1, any_value(header_2) AS header_2,
    any_value(header_3) AS header_3,
    string_agg(CASE WHEN opens = 1 THEN '' WHEN pp = para THEN chr(10) ELSE '  ' || chr(10) END || line, '' ORDER BY pos) AS content
  FROM l8 GROUP BY source, section)
"""


@register("md_sections", SECTIONS_SQL + "SELECT * FROM sections")
def md_sections(spark, sf_dir):
    return E.markdown_sections(markdown(spark, sf_dir)).select(
        "source", "section", "header_1", "header_2", "header_3", "content")


@register("size_split")
def size_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return E.split_long(d).select("doc_id", "piece", "content")


def _lines(text: str) -> list[str]:
    """Splitter that fails on some texts, as a user's may."""
    if text.count("\n") % 3 == 2:
        raise ValueError("two lines too many")
    return text.split("\n")


@register("split_fallback", r"""
WITH d AS (SELECT doc_id, text, len(text) - len(replace(text, chr(10), '')) AS breaks FROM documents WHERE text <> '')
SELECT doc_id, breaks % 3 = 2 AS plain, CASE WHEN breaks % 3 = 2 THEN 1 ELSE len(list_filter(string_split(text, chr(10)), lambda l: l <> '')) END AS sections,
  md5(regexp_replace(text, '\s+', '', 'g')) AS digest FROM d""")
def split_fallback(spark, sf_dir):
    """A splitter that fails on a third of the documents: these are cut by size alone, and nothing of any text is lost."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).where("content <> ''")
    pieces = E.split_or_fall_back(d, _lines, settings=replace(DEFAULTS, chunk_overlap=0))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "piece", "content"))), lambda p: p["content"]), "")
    return pieces.groupBy("doc_id").agg(
        F.first("error_message").isNotNull().alias("plain"), F.count_distinct("section").alias("sections"),
        F.md5(F.regexp_replace(whole, r"\s+", "")).alias("digest"))


@register("split_udtf", r"""
SELECT doc_id, true AS fits, md5(regexp_replace(text, '\s+', '', 'g')) AS digest FROM documents WHERE text <> ''""")
def split_udtf(spark, sf_dir):
    """The size split as a table function of SQL; without overlap the pieces hold the whole text."""
    sql_access.publish(spark, texts=table(spark, sf_dir, "documents").select("doc_id", "text"))
    pieces = sql_access.ask(spark, "SELECT * FROM split_text(TABLE(texts) PARTITION BY (doc_id), 'text', 1000, 0)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "")
    return pieces.groupBy("doc_id").agg((F.max(F.length("text")) <= 1000).alias("fits"), F.md5(F.regexp_replace(whole, r"\s+", "")).alias("digest"))


@register("build_chunks")
def build_chunks(spark, sf_dir):
    return E.build_chunks(markdown(spark, sf_dir))


def _ladder(text: str, rules, file: bool) -> str:
    arms = []
    for r in rules:
        arms.append((any_contains(text, r.content_terms), r.category, r.priority))
    if file:
        arms += [(any_contains("stem", r.file_terms), r.category, r.priority) for r in rules]
    cat = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in arms) + f" ELSE '{R.CHUNK_DEFAULT[0]}' END"
    pri = "CASE " + " ".join(f"WHEN {c} THEN '{p}'" for c, _, p in arms) + f" ELSE '{R.CHUNK_DEFAULT[1]}' END"
    return f"{cat} AS category, {pri} AS priority"


FIT = (
    R.ChunkRule("billing", "high", ("idiot", "chkeit"), ("src1",)),
    R.ChunkRule("technical", "high", ("stupid", "ouan"), ("src2",)),
    R.ChunkRule("onboarding", "medium", ("hate",), ("src3", "src5")),
)
FIT_TYPES = (("guide", ("thinh", "ción")), ("faq", ("und",)))


@register("chunk_category", f"""
WITH c AS (SELECT doc_id, lower(text) AS t, source AS stem, CASE WHEN doc_id % 3 = 0 THEN 'error_log' WHEN doc_id % 3 = 1 THEN 'getting' ELSE 'notes' END AS own_stem FROM documents),
f AS (SELECT doc_id, {_ladder('t', FIT, True)} FROM c),
o AS (SELECT doc_id, {_ladder('t', R.CHUNK_RULES, True).replace('category', 'own_category').replace('priority', 'own_priority')} FROM (SELECT doc_id, t, own_stem AS stem FROM c))
SELECT * FROM f JOIN o USING (doc_id)""")
def chunk_category(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/docs/v1.2/"), F.col("source"), F.lit(".md"))
    own = F.when(F.col("doc_id") % 3 == 0, F.lit("a/error_log.md")).when(F.col("doc_id") % 3 == 1, F.lit("Getting.md")).otherwise(F.lit("notes"))
    return d.withColumns({
        "fit": E.chunk_category(F.col("text"), path, FIT), "own": E.chunk_category(F.col("text"), own),
    }).select("doc_id", "fit.category", "fit.priority", F.col("own.category").alias("own_category"),
              F.col("own.priority").alias("own_priority"))


def _types_sql(types, default=R.DOC_TYPE_DEFAULT) -> str:
    return "CASE " + " ".join(f"WHEN {any_contains('lower(text)', t)} THEN '{n}'" for n, t in types) + f" ELSE '{default}' END"


@register("chunk_doctype", f"""
SELECT doc_id, {_types_sql(FIT_TYPES)} AS doc_type, {_types_sql(R.DOC_TYPES)} AS own_type FROM (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'How to ' || text WHEN doc_id % 10 = 1 THEN '#### Problem: ' || text ELSE text END AS text FROM documents)""")
def chunk_doctype(spark, sf_dir):
    k = F.col("doc_id") % 10
    text = F.when(k == 0, F.concat(F.lit("How to "), F.col("text"))).when(k == 1, F.concat(F.lit("#### Problem: "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", E.doc_type(text, FIT_TYPES).alias("doc_type"), E.doc_type(text).alias("own_type"))


WORDS_SQL = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> '')"


@register("tokenize", f"""
SELECT doc_id, CAST(len(w) AS INTEGER) AS tokens, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_tokens, md5(array_to_string(w, ' ')) AS digest
FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents)""")
def tokenize(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("tokens"), F.size(F.array_distinct("w")).alias("distinct_tokens"),
                    F.md5(F.array_join("w", " ")).alias("digest"))


def stats_ctes(docs: str = "SELECT doc_id, text FROM documents") -> str:
    """CTEs d_len, post, term_stats, corpus over (doc_id, text) rows."""
    return f"""d_words AS MATERIALIZED (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM ({docs})),
d_len AS (SELECT doc_id, len(w) AS dl FROM d_words),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d_words) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d_len),
raw_idf AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
term_stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf)
"""


@register("bm25_stats", "WITH " + stats_ctes() + "SELECT term, df, round(idf, 6) AS idf FROM term_stats")
def bm25_stats(spark, sf_dir):
    ix = IX.build_keyword_index(table(spark, sf_dir, "documents"))
    return ix.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register("index_append", "WITH " + stats_ctes(
    "SELECT doc_id, text FROM documents UNION ALL SELECT page_id + 1000000, html FROM pages"
) + "SELECT CASE WHEN df = 1 THEN 'single' ELSE 'shared' END AS kind, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, round(avg(idf), 6) AS avg_idf FROM term_stats GROUP BY 1")
def index_append(spark, sf_dir):
    """Pages added to the stored document index as a segment of their own; statistics are merged, known ids skipped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000).alias("doc_id"), F.col("html").alias("text"))
    ix = P.append(P.create(d), p.unionByName(d))
    kind = F.when(F.col("df") == 1, F.lit("single")).otherwise(F.lit("shared"))
    return ix.terms.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("terms"), F.sum("df").alias("postings"), F.round(F.avg("idf"), 6).alias("avg_idf"))


@register("chunk_counts", SECTIONS_SQL + "SELECT source, count(*) AS chunks FROM sections GROUP BY source")
def chunk_counts(spark, sf_dir):
    return E.chunk_counts(E.markdown_sections(markdown(spark, sf_dir)))
