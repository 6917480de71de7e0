"""Search queries: benchmark items ask, documents and their embeddings answer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark.functions.encoders import hashed_vectors
from deskspark.functions.isolation import isolated
from deskspark.operators import index as IX
from deskspark.operators import postings as P
from deskspark.operators import retrieval as F_
from deskspark.operators import vectors as V
from deskspark.operators.ranking import keyword_top
from deskspark.registry import register
from deskspark.registry.corpus import WORDS_SQL, stats_ctes
from deskspark.registry.views import any_contains, mails, sql_strip, table, with_ctes
from deskspark.session import materialise
from deskspark.settings import DEFAULTS


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def asking(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return b.join(e, "query_id", "left")


def labelled_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.filter(F.col("label").isin(3, 7)).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def stored_vectors(spark, sf_dir):
    return V.build(vectors(spark, sf_dir))


def document_index(spark, sf_dir):
    return P.create(documents(spark, sf_dir))


def content_index(spark, sf_dir):
    return F_.text_index(documents(spark, sf_dir))


def rounded(df, column="score"):
    """Reported score. The mean idf is a sum over all terms in no fixed order: its last digits are noise."""
    return df.withColumn(column, F.round(column, 6))


QUERIES_SQL = """queries AS (SELECT item_id AS qid, b.text, e.embedding AS vector
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""


def near_cte(k: int, source: str = "queries") -> str:
    return f"""near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, doc_id) AS INTEGER) AS rank FROM (
  SELECT q.qid, e.vec_id AS doc_id, round(pow(array_distance(q.vector::DOUBLE[64], e.embedding::DOUBLE[64]), 2), 9) AS d
  FROM {source} q CROSS JOIN embeddings e WHERE q.vector IS NOT NULL)) WHERE rank <= {k})"""


def kw_cte(source: str = "queries") -> str:
    return f"""q_terms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({WORDS_SQL.format('text')}) AS term FROM {source}) GROUP BY ALL),
kw AS (SELECT qid, doc_id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM corpus))))), 9) AS score
  FROM q_terms JOIN term_stats USING (term) JOIN post USING (term) JOIN d_len USING (doc_id) GROUP BY qid, doc_id)"""


def kw_top_cte(k: int) -> str:
    return f"""kw_top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM kw WHERE score > 0) WHERE rank <= {k})"""


def hybrid_cte(k: int, alpha: float, source: str = "queries") -> str:
    return f"""{near_cte(2 * k, source)}, {kw_cte(source)},
contents AS (SELECT doc_id, md5(text) AS ck FROM documents),
sem AS (SELECT qid, ck, max(d) AS dist, arg_min(doc_id, (d, doc_id)) AS hit_id FROM near JOIN contents USING (doc_id) GROUP BY ALL),
kwc AS (SELECT qid, ck, max(score) AS score FROM kw JOIN contents USING (doc_id) GROUP BY ALL),
kwn AS (SELECT qid, ck, score / CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN max(score) OVER (PARTITION BY qid) ELSE 1 END AS kw FROM kwc),
fusion AS (SELECT coalesce(sem.qid, kwn.qid) AS qid, coalesce(sem.ck, kwn.ck) AS ck, hit_id, round(coalesce(kw, 0), 9) AS kw,
    round({alpha} * coalesce(1 / (1 + dist), 0) + (1 - {alpha}) * coalesce(kw, 0), 9) AS fused
  FROM sem FULL JOIN kwn ON sem.qid = kwn.qid AND sem.ck = kwn.ck),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, kw DESC, ck) AS place FROM fusion),
hybrid AS (SELECT qid, hit_id AS doc_id, round(1 - fused, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS INTEGER) AS rank
  FROM placed WHERE place <= {k} AND hit_id IS NOT NULL)"""


@register("knn", "WITH q AS (SELECT vec_id AS qid, embedding AS vector FROM embeddings), " + near_cte(4, "q") + """
SELECT qid AS query_id, doc_id, d AS distance, rank FROM near""")
def knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return V.search(v.withColumnRenamed("doc_id", "query_id"), V.build(v), 4)


@register("knn_filtered", """WITH near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, doc_id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS qid, e.vec_id AS doc_id, round(pow(array_distance(q.embedding::DOUBLE[64], e.embedding::DOUBLE[64]), 2), 9) AS d
  FROM embeddings q CROSS JOIN embeddings e WHERE e.label IN (3, 7))) WHERE rank <= 4)
SELECT qid AS query_id, doc_id, d AS distance, rank FROM near""")
def knn_filtered(spark, sf_dir):
    """Metadata filter applied before the vectors are stored, so it reaches the scan."""
    e = table(spark, sf_dir, "embeddings")
    items = labelled_vectors(spark, sf_dir)
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.search(q, V.build(items), 4)


@register("bm25", f"WITH {QUERIES_SQL}, {stats_ctes()}, {kw_cte()}, {kw_top_cte(10)} SELECT qid AS query_id, doc_id, round(score, 6) AS score, rank FROM kw_top")
def bm25(spark, sf_dir):
    return rounded(P.search(asking(spark, sf_dir), document_index(spark, sf_dir), 10))


@register("score_fusion", f"""WITH {QUERIES_SQL}, {stats_ctes()}, {near_cte(8)}, {kw_cte()}, {kw_top_cte(10)},
n AS (SELECT qid, doc_id, score / max(score) OVER (PARTITION BY qid) AS kw FROM kw_top)
SELECT coalesce(near.qid, n.qid) AS query_id, coalesce(near.doc_id, n.doc_id) AS doc_id,
  round(0.5 * coalesce(1 / (1 + d), 0) + 0.5 * coalesce(kw, 0), 6) AS fused
FROM near FULL JOIN n ON near.qid = n.qid AND near.doc_id = n.doc_id""")
def score_fusion(spark, sf_dir):
    q, ix = asking(spark, sf_dir), document_index(spark, sf_dir)
    near = materialise(V.search(q, stored_vectors(spark, sf_dir), 8), "near")
    sem = near.select("query_id", "doc_id", F_.similarity(F.col("distance")).alias("semantic"))
    kw = P.search(q, ix, 10)
    kw = F_.max_normalised(kw).select("query_id", "doc_id", F.col("score").alias("keyword"))
    return rounded(F_.fuse(sem, kw, 0.5), "fused")


@register("hybrid_search", f"WITH {QUERIES_SQL}, {stats_ctes()}, {hybrid_cte(4, 0.7)} SELECT qid AS query_id, doc_id, round(score, 6) AS score, rank FROM hybrid")
def hybrid_search(spark, sf_dir):
    return rounded(F_.hybrid_search(asking(spark, sf_dir), stored_vectors(spark, sf_dir), content_index(spark, sf_dir), 4, 0.7))


RRF_CTE = """fused AS (SELECT qid, ck, round(sum(1.0 / (60 + rank)), 9) AS score, min((list_id, rank)) AS seen, arg_min(doc_id, (list_id, rank)) AS doc_id
  FROM lists GROUP BY qid, ck),
rrf AS (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc_id) AS INTEGER) AS rank FROM fused)"""


@register("rrf", f"""WITH {QUERIES_SQL}, {stats_ctes()}, {near_cte(8)}, {kw_cte()}, {kw_top_cte(8)},
lists AS (SELECT qid, 0 AS list_id, doc_id, md5(text) AS ck, rank FROM near JOIN documents USING (doc_id)
  UNION ALL SELECT qid, 1, doc_id, md5(text), rank FROM kw_top JOIN documents USING (doc_id)), {RRF_CTE}
SELECT qid AS query_id, doc_id, score, rank FROM rrf""")
def rrf(spark, sf_dir):
    q, ix, docs = asking(spark, sf_dir), document_index(spark, sf_dir), documents(spark, sf_dir)
    a = V.search(q, stored_vectors(spark, sf_dir), 8).select("query_id", F.lit(0).alias("list_id"), "doc_id", "rank")
    b = P.search(q, ix, 8).select("query_id", F.lit(1).alias("list_id"), "doc_id", "rank")
    keys = docs.select("doc_id", F.md5("text").alias("content_key"))
    return F_.reciprocal_rank_fusion(materialise(a.unionByName(b), "lists").join(keys, "doc_id"))


def coverage_sql(query: str, text: str) -> str:
    q, d = WORDS_SQL.format(query), WORDS_SQL.format(text)
    return f"len(list_intersect(list_distinct({q}), list_distinct({d}))) / CAST(len(list_distinct({q})) AS DOUBLE)"


@register("rerank", f"""WITH {QUERIES_SQL}, {stats_ctes()}, {kw_cte()}, {kw_top_cte(12)},
c AS (SELECT k.qid, k.doc_id, k.rank, k.score, round({coverage_sql('q.text', 'd.text')}, 9) AS s, count(*) OVER (PARTITION BY k.qid) AS n
  FROM kw_top k JOIN queries q USING (qid) JOIN documents d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n > 4 THEN s END DESC, rank) AS place FROM c)
SELECT qid AS query_id, doc_id, CASE WHEN n > 4 THEN round(1 - s, 9) ELSE score END AS score, CAST(place AS INTEGER) AS rank FROM r WHERE place <= 4""")
def rerank(spark, sf_dir):
    q, ix, docs = asking(spark, sf_dir), document_index(spark, sf_dir), documents(spark, sf_dir)
    found = P.search(q, ix, 12)
    rows = found.join(docs, "doc_id").join(q.select("query_id", F.col("text").alias("query")), "query_id")
    return F_.rerank(rows, 4).select("query_id", "doc_id", "score", "rank")


def _moody(queries: list[str], texts: list[str]) -> list[float]:
    """Pair scorer that fails on some texts, as a user's may."""
    if any(len(t) % 11 == 0 for t in texts):
        raise RuntimeError("a text of this length")
    return [len(t) % 97 / 97 for t in texts]


@register("rerank_fallback", f"""WITH {QUERIES_SQL}, {stats_ctes()}, {kw_cte()}, {kw_top_cte(12)},
c AS (SELECT k.qid, k.doc_id, k.rank, k.score, round(len(d.text) % 97 / 97.0::DOUBLE, 9) AS s, len(d.text) % 11 = 0 AS bad, count(*) OVER (PARTITION BY k.qid) AS n
  FROM kw_top k JOIN documents d USING (doc_id)),
f AS (SELECT *, bool_or(bad) OVER (PARTITION BY qid) AS failed FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n > 4 AND NOT failed THEN s END DESC, rank) AS place FROM f)
SELECT qid AS query_id, doc_id, failed, round(CASE WHEN n > 4 AND NOT failed THEN 1 - s ELSE score END, 6) AS score, CAST(place AS INTEGER) AS rank FROM r WHERE place <= 4""")
def rerank_fallback(spark, sf_dir):
    """A scorer that fails on some texts: their queries keep the order they had, all others are re-ranked."""
    q, ix, docs = asking(spark, sf_dir), document_index(spark, sf_dir), documents(spark, sf_dir)
    rows = P.search(q, ix, 12).join(docs, "doc_id").join(q.select("query_id", F.col("text").alias("query")), "query_id")
    out = F_.rerank_or_keep(rows, 4, isolated(_moody, "double"))
    return rounded(out.select("query_id", "doc_id", F.col("error_message").isNotNull().alias("failed"), "score", "rank"))


CLEAN_LINES_SQL = ("list_transform(list_filter(list_transform(string_split({0}, chr(10)), lambda l: " + sql_strip("l")
                   + r"), lambda l: len(l) > 10), lambda l: regexp_replace(l, '^\d+[.)]\s*', ''))")


@register("query_variants", with_ctes("mails") + f"""
, v AS (SELECT id, subject AS q, '1. ' || replace(body, chr(10), chr(10) || ' 2)  ') AS raw FROM mails),
x AS (SELECT id, CASE WHEN len({WORDS_SQL.format('q')}) < 3 THEN [q] ELSE list_concat([q], ({CLEAN_LINES_SQL.format('raw')})[1:3]) END AS list FROM v)
SELECT id, CAST(unnest(range(len(list))) AS INTEGER) AS pos, unnest(list) AS variant FROM x""")
def query_variants(spark, sf_dir):
    raw = F.concat(F.lit("1. "), F.replace(F.col("body"), F.lit("\n"), F.lit("\n 2)  ")))
    v = F_.query_variants(F.col("subject"), raw)
    return mails(spark, sf_dir).select("id", F.posexplode(v).alias("pos", "variant"))


@register("query_decompose", f"""
WITH t AS (SELECT conv_id, turn, text AS q, CASE WHEN turn % 3 = 0 THEN 'short' ELSE '1) ' || replace(text, '. ', chr(10) || '2. ') END AS raw FROM conversations),
x AS (SELECT *, {any_contains('lower(q)', R.COMPLEX_MARKS)} AND len({WORDS_SQL.format('q')}) > 10 AS is_complex, ({CLEAN_LINES_SQL.format('raw')})[1:3] AS lines FROM t),
y AS (SELECT conv_id, turn, is_complex, CASE WHEN is_complex AND len(lines) > 0 THEN lines ELSE [q] END AS list FROM x)
SELECT conv_id, turn, is_complex, CAST(unnest(range(len(list))) AS INTEGER) AS pos, unnest(list) AS sub_query FROM y""")
def query_decompose(spark, sf_dir):
    raw = F.when(F.col("turn") % 3 == 0, F.lit("short")).otherwise(
        F.concat(F.lit("1) "), F.replace(F.col("text"), F.lit(". "), F.lit("\n2. "))))
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F_.is_complex(F.col("text")).alias("is_complex"),
                    F.posexplode(F_.sub_queries(F.col("text"), raw)).alias("pos", "sub_query"))


@register("rewrite_gate", f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '?' ELSE text END AS q,
  CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || substr(text, 1, 60) || ' ' WHEN 2 THEN substr(text, 1, 40) ELSE text END AS r FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT (len({WORDS_SQL.format('q')}) > 8 AND contains(q, '?')) AND len({sql_strip('r')}) > 10 AND len({sql_strip('r')}) < 200
  THEN {sql_strip('r')} ELSE q END AS query FROM t""")
def rewrite_gate(spark, sf_dir):
    turn = F.col("turn")
    q = F.when(turn % 2 == 0, F.concat(F.col("text"), F.lit("?"))).otherwise(F.col("text"))
    r = (F.when(turn % 4 == 0, F.lit(None)).when(turn % 4 == 1, F.concat(F.lit(" "), F.substring("text", 1, 60), F.lit(" ")))
         .when(turn % 4 == 2, F.substring("text", 1, 40)).otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F_.accepted_rewrite(q, r).alias("query"))


def compress_cte(source: str, query: str, content: str, n: int, keys: str, out: str) -> str:
    return rf"""cs1 AS (SELECT {keys}, {content} AS content, list_distinct({WORDS_SQL.format(query)}) AS qw,
    string_split(regexp_replace({content}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS sents FROM {source}),
cs2 AS (SELECT *, list_sort(list_transform(sents, lambda s, i: {{'s': -len(list_intersect(qw, list_distinct({WORDS_SQL.format('s')}))), 'pos': i, 't': s}}))[1:{n}] AS best FROM cs1),
cs3 AS (SELECT *, list_transform(best, lambda b: b.t) AS chosen FROM cs2),
{out} AS (SELECT {keys}, len(sents) > {n} AS compressed,
    CASE WHEN len(sents) > {n} THEN array_to_string(list_filter(sents, lambda s: list_contains(chosen, s))[1:{n}], ' ') ELSE content END AS content FROM cs3)"""


@register("compress", with_ctes("mails") + ", " + compress_cte("mails", "subject", "body", 3, "id", "done") + " SELECT * FROM done")
def compress(spark, sf_dir):
    m = mails(spark, sf_dir).select("id", F_.compress(F.col("subject"), F.col("body"), 3).alias("c"))
    return m.select("id", "c.content", "c.compressed")


STANDARD_SQL = f"""asked0 AS (SELECT item_id AS qid, b.text AS original, e.embedding AS vector,
    CASE WHEN item_id % 3 = 0 THEN 'please: ' || replace(b.text, ',', '') WHEN item_id % 3 = 1 THEN 'too short' END AS rewrite
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
queries AS (SELECT qid, original, vector, CASE WHEN NOT (len({WORDS_SQL.format('original')}) > 8 AND contains(original, '?'))
    AND len({sql_strip('rewrite')}) > 10 AND len({sql_strip('rewrite')}) < 200 THEN {sql_strip('rewrite')} ELSE original END AS text FROM asked0),
{stats_ctes()}, {hybrid_cte(6, 0.7)},
c AS (SELECT h.qid, h.doc_id, h.rank, h.score, q.original, d.text, round({coverage_sql('q.text', 'd.text')}, 9) AS s, count(*) OVER (PARTITION BY h.qid) AS n
  FROM hybrid h JOIN queries q USING (qid) JOIN documents d USING (doc_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n > 2 THEN s END DESC, rank) AS INTEGER) AS place FROM c),
cut AS (SELECT qid AS query_id, place AS rank, doc_id, CASE WHEN n > 2 THEN round(1 - s, 9) ELSE score END AS score, original, text FROM r WHERE place <= 2),
{compress_cte('cut', 'original', 'text', 4, 'query_id, rank, doc_id, score', 'done')}
SELECT * REPLACE (round(score, 6) AS score) FROM done"""


def with_rewrites(q):
    kind = F.col("query_id") % 3
    return q.withColumn("rewrite", F.when(kind == 0, F.concat(F.lit("please: "), F.replace(F.col("text"), F.lit(","), F.lit("")))).when(kind == 1, F.lit("too short")))


@register("retrieve_standard", "WITH " + STANDARD_SQL)
def retrieve_standard(spark, sf_dir):
    q = with_rewrites(asking(spark, sf_dir))
    found = F_.retrieve(q, documents(spark, sf_dir), stored_vectors(spark, sf_dir), content_index(spark, sf_dir), 2)
    return rounded(found)


ADVANCED_SQL = f"""base AS (SELECT item_id, b.text, e.embedding AS vector, replace(b.text, '. ', chr(10)) AS lines
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
s0 AS (SELECT *, ({CLEAN_LINES_SQL.format('lines')})[1:3] AS parts, {any_contains('lower(text)', R.COMPLEX_MARKS)} AND len({WORDS_SQL.format('text')}) > 10 AS cx FROM base),
s1 AS (SELECT *, CASE WHEN cx AND len(parts) > 0 THEN parts ELSE [text] END AS subs FROM s0),
s2 AS (SELECT item_id, vector, lines, unnest(range(len(subs))) AS sub_no, unnest(subs) AS sub FROM s1),
s3 AS (SELECT *, CASE WHEN len({WORDS_SQL.format('sub')}) < 3 THEN [sub] ELSE list_concat([sub], ({CLEAN_LINES_SQL.format('lines')})[1:2]) END AS vars FROM s2),
s4 AS (SELECT item_id, vector, sub_no, unnest(range(len(vars))) AS var_no, unnest(vars) AS text FROM s3),
queries AS (SELECT (item_id, sub_no * 10 + var_no) AS qid, item_id, sub_no * 10 + var_no AS list_id, text, vector FROM s4),
{stats_ctes()}, {hybrid_cte(4, 0.7)},
lists AS (SELECT q.item_id AS qid, q.list_id, h.doc_id, md5(d.text) AS ck, h.rank FROM hybrid h JOIN queries q ON q.qid = h.qid JOIN documents d USING (doc_id)),
{RRF_CTE},
c AS (SELECT f.qid, f.doc_id, f.rank, f.score, b.text AS original, d.text, round({coverage_sql('b.text', 'd.text')}, 9) AS s, count(*) OVER (PARTITION BY f.qid) AS n
  FROM rrf f JOIN base b ON b.item_id = f.qid JOIN documents d USING (doc_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN n > 2 THEN s END DESC, rank) AS INTEGER) AS place FROM c),
cut AS (SELECT qid AS query_id, place AS rank, doc_id, CASE WHEN n > 2 THEN round(1 - s, 9) ELSE score END AS score, original, text FROM r WHERE place <= 2),
{compress_cte('cut', 'original', 'text', 4, 'query_id, rank, doc_id, score', 'done')}
SELECT * FROM done"""


def with_variants(q):
    lines = F.replace(F.col("text"), F.lit(". "), F.lit("\n"))
    return q.withColumns({"parts": lines, "variants": lines})


VARIED = replace(DEFAULTS, use_variants=True, use_decomposition=True)


@register("retrieve_advanced", "WITH " + ADVANCED_SQL)
def retrieve_advanced(spark, sf_dir):
    q = with_variants(asking(spark, sf_dir))
    return F_.retrieve(q, documents(spark, sf_dir), stored_vectors(spark, sf_dir), content_index(spark, sf_dir), 2, VARIED)


@register("corpus_probe", f"""WITH {QUERIES_SQL}, {near_cte(2)}
SELECT qid AS query_id, rank, doc_id, d AS distance, replace(substr(text, 1, 150), chr(10), ' ') AS preview FROM near JOIN documents USING (doc_id)""")
def corpus_probe(spark, sf_dir):
    """The two nearest documents of every item, with a preview of each."""
    return F_.probe(asking(spark, sf_dir), documents(spark, sf_dir), stored_vectors(spark, sf_dir))


# ---- the same with vectors of the texts that are searched ---------------------------------


def encoded_cte(name: str, source: str, key: str) -> str:
    """CTE (key, vector): hashed bag-of-words vectors of (key, text) rows."""
    return f"""{name}_n AS (SELECT {key} AS k, CAST(('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS INTEGER) AS b, count(*) AS n
  FROM (SELECT {key}, unnest({WORDS_SQL.format('text')}) AS word FROM {source}) GROUP BY ALL),
{name}_u AS (SELECT k, sqrt(sum(n * n)) AS norm FROM {name}_n GROUP BY k),
{name}_c AS (SELECT u.k, r.b, coalesce(n.n, 0) / u.norm AS c FROM {name}_u u CROSS JOIN (SELECT unnest(range(64))::INTEGER AS b) r LEFT JOIN {name}_n n ON n.k = u.k AND n.b = r.b),
{name} AS (SELECT k AS {key}, list(c ORDER BY b) AS vector FROM {name}_c GROUP BY k)"""


def encoded_sql(sql: str) -> str:
    """The statement with encoded documents in place of the given vectors, and queries searched by vectors of their texts."""
    head, tail = sql.split("\nqueries AS (", 1)
    body, rest = tail.split("),\n", 1)
    queries = f"plain AS ({body}),\n{encoded_cte('asked_vectors', 'plain', 'qid')},\n" \
        "queries AS (SELECT p.* EXCLUDE (vector), v.vector FROM plain p LEFT JOIN asked_vectors v ON v.qid = p.qid),\n"
    docs = encoded_cte("doc_vectors", "documents", "doc_id")
    return f"""WITH {docs}, {head.replace('e.embedding', 'NULL::DOUBLE[]')}
{queries}{rest.replace('CROSS JOIN embeddings e', 'CROSS JOIN (SELECT doc_id AS vec_id, vector AS embedding FROM doc_vectors) e')}"""


def encoder(rows):
    return hashed_vectors(rows, "query_id")


def encoded_documents(spark, sf_dir):
    return V.build(materialise(hashed_vectors(documents(spark, sf_dir), "doc_id"), "document_vectors", free=True))


def texts_asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@register("retrieve_standard_encoded", encoded_sql(STANDARD_SQL))
def retrieve_standard_encoded(spark, sf_dir):
    """An accepted rewrite is searched by its own vector, among vectors of the documents from the same encoder."""
    return rounded(F_.retrieve(
        with_rewrites(texts_asked(spark, sf_dir)), documents(spark, sf_dir), encoded_documents(spark, sf_dir),
        content_index(spark, sf_dir), 2, encoder=encoder))


@register("retrieve_advanced_encoded", encoded_sql(ADVANCED_SQL))
def retrieve_advanced_encoded(spark, sf_dir):
    """Every part and variant of a query is searched by its own vector."""
    return F_.retrieve(
        with_variants(texts_asked(spark, sf_dir)), documents(spark, sf_dir), encoded_documents(spark, sf_dir),
        content_index(spark, sf_dir), 2, VARIED, encoder)


# ---- mails against a small knowledge base (the benchmark items) ----------------------------

KB_DOCS = "SELECT item_id AS doc_id, text FROM benchmark"
DUAL_SQL = with_ctes("mails") + f""", {stats_ctes(KB_DOCS)},
queries AS (SELECT id || '/0' AS qid, subject AS text FROM mails UNION ALL SELECT id || '/1', body FROM mails),
{kw_cte()}, {kw_top_cte(1)},
hits AS (SELECT split_part(qid, '/', 1) AS id, CAST(split_part(qid, '/', 2) AS INTEGER) AS part, k.doc_id, k.score, b.text AS content, md5(b.text) AS ck
  FROM kw_top k JOIN benchmark b ON b.item_id = k.doc_id),
once AS (SELECT id, ck, min(part) AS part, arg_min(doc_id, part) AS doc_id, arg_min(score, part) AS score, arg_min(content, part) AS content FROM hits GROUP BY id, ck),
dual AS (SELECT id, doc_id, score, content, CAST(row_number() OVER (PARTITION BY id ORDER BY part) AS INTEGER) AS rank FROM once)
"""


def knowledge_base(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def dual_hits(spark, sf_dir):
    kb = knowledge_base(spark, sf_dir)
    ix = IX.stored_index(kb)
    parts = mails(spark, sf_dir).select("id", F.posexplode(F.array("subject", "body")).alias("part", "text"))
    q = parts.select(F.concat_ws("/", "id", F.col("part").cast("string")).alias("query_id"), "text")
    found = keyword_top(q, kb, ix.terms, ix.corpus, 1)
    split = F.split("query_id", "/")
    hits = found.join(kb.withColumnRenamed("text", "content"), "doc_id").select(
        split[0].alias("id"), split[1].cast("int").alias("part"), F.md5("content").alias("content_key"),
        "doc_id", "score", "content")
    docs = F_.subject_and_body_hits(hits).select("id", F.posexplode("docs").alias("pos", "d"))
    return docs.select("id", (F.col("pos") + 1).alias("rank"), "d.doc_id", "d.score", "d.content",
                       F.concat(F.lit("item "), F.col("d.doc_id")).alias("source"))


@register("dual_retrieve", DUAL_SQL + "SELECT id, rank, doc_id, round(score, 6) AS score FROM dual")
def dual_retrieve(spark, sf_dir):
    return rounded(dual_hits(spark, sf_dir).select("id", "rank", "doc_id", "score"))


@register("context_text", DUAL_SQL + """
, t AS (SELECT id, string_agg('[Source: item ' || doc_id || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM dual GROUP BY id)
SELECT m.id, coalesce(context, 'No relevant documentation found.') AS context FROM mails m LEFT JOIN t USING (id)""")
def context_text(spark, sf_dir):
    c = F_.context_text(dual_hits(spark, sf_dir))
    return mails(spark, sf_dir).select("id").join(c, "id", "left").select("id", F_.context_or_none(F.col("context")).alias("context"))


@register("retrieval_summary", DUAL_SQL + """
SELECT id, count(*) AS docs_retrieved, string_agg('item ' || doc_id, ', ' ORDER BY rank) AS sources FROM dual GROUP BY id""")
def retrieval_summary(spark, sf_dir):
    s = F_.retrieval_summary(dual_hits(spark, sf_dir))
    return s.select("id", "docs_retrieved", F.array_join("sources", ", ").alias("sources"))
