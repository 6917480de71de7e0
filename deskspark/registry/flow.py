"""The mail flow from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskspark.operators import index as IX
from deskspark.operators import quality as Q
from deskspark.plans import mail_flow as P
from deskspark.registry import register
from deskspark.registry.accounts import SUMMARY_SQL, TYPED_SQL, typed
from deskspark.registry.classify import FITTED, ladder_sql
from deskspark.registry.quality import quality_cte, redact_sql
from deskspark.registry.reply import DIGEST_SQL, NAME_SQL, signature_sql
from deskspark.registry.retrieval import KB_DOCS, knowledge_base, kw_cte, kw_top_cte
from deskspark.registry.corpus import stats_ctes
from deskspark.registry.views import CTES, any_contains, mails, mails_of, table
from deskspark.rules import ESCALATION_TERMS, LADDER_DEFAULT, SLOT_DEFAULTS
from deskspark.session import shared_dir
from deskspark.sources.mail import stream_table
from deskspark.streaming import flow_stream as MS
from deskspark.streaming import ledger as L

AS_OF = "1998-06-15 12:30:00"
ACCOUNT_WORDS = ["ment", "ption", "hate"]


def addressed(m):
    return m.select("id", F.concat(F.lit("user"), F.col("doc_id"), F.lit("@example.com")).alias("sender"),
                    "subject", "body", "received_at")


def sides(spark, sf_dir):
    """What mails are answered from: account rows and the knowledge base."""
    kb = knowledge_base(spark, sf_dir)
    return typed(spark, sf_dir), P.Knowledge(kb, IX.stored_index(kb))


def flow(spark, sf_dir, redraft=None):
    accounts, known = sides(spark, sf_dir)
    return P.mail_flow(addressed(mails(spark, sf_dir)), accounts, known, AS_OF, ladder=FITTED,
                       account_terms=ACCOUNT_WORDS, redraft=redraft)


def _reply(text: str) -> str:
    return f"'Dear ' || name || ',' || chr(10) || chr(10) || {text} || chr(10) || chr(10) || '{P.CLOSING}'"


FLOW_HEAD = "WITH " + CTES["mails"] + f""",
x AS (SELECT id, 'user' || doc_id || '@example.com' AS sender, subject, body, received_at, lower(subject) || ' ' || lower(body) AS t FROM mails),
classed AS (SELECT *, {ladder_sql('', FITTED, LADDER_DEFAULT)} FROM x),
routed AS (SELECT *, CASE WHEN category IN ('feedback', 'feature_request') THEN 'feedback'
    WHEN category <> 'unrelated' AND confidence >= 0.5 THEN 'process' ELSE 'skip' END AS route,
    category = 'billing' OR {any_contains('lower(body)', ACCOUNT_WORDS)} AS wants,
    {NAME_SQL.format(body='body', sender='sender')} AS name, {DIGEST_SQL.format('body')} AS digest FROM classed),
{TYPED_SQL[5:]},
acct AS (SELECT email, {SUMMARY_SQL} AS account_context FROM typed),
{stats_ctes(KB_DOCS)},
queries AS (SELECT id || '/0' AS qid, subject AS text FROM mails UNION ALL SELECT id || '/1', body FROM mails),
{kw_cte()}, {kw_top_cte(1)},
hits AS (SELECT split_part(qid, '/', 1) AS id, CAST(split_part(qid, '/', 2) AS INTEGER) AS part, b.text AS content FROM kw_top k JOIN benchmark b ON b.item_id = k.doc_id),
once AS (SELECT id, content, min(part) AS part FROM hits GROUP BY id, content),
docs AS (SELECT id, string_agg(content, chr(10) || chr(10) ORDER BY part) AS doc_context, count(*) AS n FROM once GROUP BY id),
ctx AS (SELECT r.*, a.account_context, CASE WHEN r.route = 'process' AND r.category <> 'product_inquiry' THEN d.doc_context END AS doc_context,
    CASE WHEN r.route = 'process' AND r.category <> 'product_inquiry' THEN coalesce(d.n, 0) ELSE 0 END AS n
  FROM routed r LEFT JOIN acct a ON a.email = r.sender AND r.route = 'process' AND r.wants LEFT JOIN docs d ON d.id = r.id),
written AS (SELECT *, CASE WHEN route = 'feedback' THEN {_reply("'" + P.THANKS + "'")}
    ELSE {_reply("'Thank you for your message about ' || subject || '.' || chr(10) || chr(10) || coalesce(account_context, nullif(doc_context, ''), '" + SLOT_DEFAULTS['context'] + "')")} END AS raw FROM ctx),
signed AS (SELECT *, {signature_sql('raw')} AS reply FROM written)
"""

FLOW_SQL = FLOW_HEAD + f"""{quality_cte('signed')},
done AS (SELECT *, CASE WHEN route = 'skip' THEN 'completed_skipped' WHEN route = 'feedback' OR approved THEN 'completed_approved' ELSE 'requires_manual_review' END AS status,
    CASE WHEN route = 'skip' THEN '' WHEN route = 'process' THEN {redact_sql('reply')} ELSE reply END AS final_response FROM scored),
act AS (SELECT *, status = 'completed_approved' AND final_response <> '' AS ok, {any_contains('lower(final_response)', ESCALATION_TERMS)} AS esc FROM done)
SELECT id, category, priority, route,
  CASE WHEN route <> 'process' THEN 'none' WHEN account_context IS NOT NULL THEN 'database' WHEN doc_context IS NOT NULL THEN 'documents' ELSE 'none' END AS context_from,
  CAST(CASE WHEN account_context IS NOT NULL THEN 1 ELSE n END AS INTEGER) AS docs_retrieved, status,
  CASE WHEN route = 'feedback' THEN 10.0 WHEN route = 'process' THEN quality_score ELSE 0.0 END AS qa_score, final_response,
  CASE WHEN route = 'feedback' THEN name || ' | ' || strftime(received_at, '%Y-%m-%d %H:%M:%S') || ' | ' || digest END AS feedback_line,
  CASE WHEN status = 'completed_skipped' THEN 'mark_read' WHEN status = 'requires_manual_review' THEN 'add_label'
    WHEN ok AND esc THEN 'add_label' WHEN ok THEN 'mark_read' ELSE 'none' END AS action,
  ok AND route <> 'feedback' AS email_sent
FROM act"""


SHOWN = ("id", "category", "priority", "route", "context_from", "docs_retrieved", "status", "qa_score",
         "final_response", "feedback_line", "action", "email_sent")


@register("mail_flow", FLOW_SQL)
def mail_flow(spark, sf_dir):
    return flow(spark, sf_dir).select(*SHOWN)


@register("stream_flow", FLOW_SQL)
def stream_flow(spark, sf_dir):
    """The mail job over a stream of documents, drained once; its committed results are those of the batch job."""
    accounts, known = sides(spark, sf_dir)
    schema = table(spark, sf_dir, "documents").schema
    stream = addressed(mails_of(stream_table(spark, f"{sf_dir}/documents.parquet", schema)))
    root = shared_dir(spark)
    work = MS.flow_batch(accounts, known, AS_OF, ladder=FITTED, account_terms=ACCOUNT_WORDS)
    L.drain(stream, L.once_per_batch(root, work), f"{root}/checkpoint")
    return L.committed(spark, root, "results").select(*SHOWN)


#: The last revision asks for more: what a third draft adds to the second.
MORE = " We understand how inconvenient this is and are here to help."


def _redraft(rows, attempt):
    text = Q.redact(F.col("draft"))
    return rows.withColumn("revised", text if attempt == 1 else F.concat(text, F.lit(MORE)))


@register("flow_revision", FLOW_HEAD + f""",
first AS (SELECT id, route, reply FROM signed WHERE route = 'process'),
second AS (SELECT id, route, {redact_sql('reply')} AS reply FROM first),
third AS (SELECT id, route, {redact_sql('reply')} || '{MORE}' AS reply FROM second),
tries AS (SELECT *, 0 AS attempt FROM first UNION ALL SELECT *, 1 FROM second UNION ALL SELECT *, 2 FROM third)
{quality_cte('tries')},
picked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY approved DESC, CASE WHEN approved THEN attempt ELSE -attempt END) AS rn FROM scored)
SELECT id, attempt AS revision_count, CASE WHEN approved THEN 'completed_approved' ELSE 'requires_manual_review' END AS status,
  quality_score AS qa_score, {redact_sql('reply')} AS final_response FROM picked WHERE rn = 1""")
def flow_revision(spark, sf_dir):
    """Replies of the mail job with two revisions: personal data taken out, then a sentence added."""
    return flow(spark, sf_dir, _redraft).where("route = 'process'").select(
        "id", "revision_count", "status", "qa_score", "final_response")


@register("flow_status", f"SELECT status, route, count(*) AS mails, round(avg(qa_score), 6) AS avg_score FROM ({FLOW_SQL}) GROUP BY status, route")
def flow_status(spark, sf_dir):
    return flow(spark, sf_dir).groupBy("status", "route").agg(
        F.count("*").alias("mails"), F.round(F.avg("qa_score"), 6).alias("avg_score"))
