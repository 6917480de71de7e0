"""The whole mail job as one DataFrame plan.

classify -> route -> {feedback | account or documents -> reply -> review | skip} -> status, action.

Mail bodies are read where they are needed (rules, retrieval) and then left behind: the rows that
are joined and shuffled carry only derived columns. Branches are columns of one row set, not
separate scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark.operators import accounts as A
from deskspark.operators import cache as I
from deskspark.operators import classify as C
from deskspark.operators import quality as Q
from deskspark.operators import reply as G
from deskspark.operators import reports as J
from deskspark.operators import retrieval as RT
from deskspark.operators.index import KeywordIndex
from deskspark.operators.ranking import keyword_top
from deskspark.plans import revision as RV
from deskspark.session import materialise
from deskspark.settings import DEFAULTS, Settings

THANKS = "Thank you for your note. We have passed it on to the people in charge."
CLOSING = "Hope you have a great day!"


@dataclass(frozen=True)
class Knowledge:
    """Knowledge base the mails are answered from: documents (doc_id, text) and their index."""

    docs: DataFrame
    index: KeywordIndex


def dual_documents(mails: DataFrame, kb: Knowledge) -> DataFrame:
    """Top documents for subject and body of each mail: (id, docs), at most two in order."""
    parts = mails.select("id", F.posexplode(F.array("subject", "body")).alias("part", "text"))
    asked = parts.select(F.to_json(F.struct("id", "part")).alias("query_id"), "text")
    found = keyword_top(asked, kb.docs, kb.index.terms, kb.index.corpus, 1)
    hits = found.join(kb.docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    key = F.from_json("query_id", "id string, part int")
    return RT.subject_and_body_hits(hits.withColumn("q", key).select(
        "q.id", "q.part", F.md5("content").alias("content_key"), "doc_id", "score", "content"))


def mail_flow(
    mails: DataFrame, accounts: DataFrame, kb: Knowledge, as_of: str,
    cache: DataFrame | None = None, replies: DataFrame | None = None,
    ladder: Sequence[R.LadderRule] = R.LADDER, account_terms: Sequence[str] = R.ACCOUNT_TERMS,
    settings: Settings = DEFAULTS, redraft: RV.Redraft | None = None,
) -> DataFrame:
    """One result row per mail.

    mails (id, sender, subject, body, received_at); accounts: typed account rows; `replies`
    (id, reply) are raw model texts, which otherwise come from a fixed wording around the context;
    `cache` rows are reused as replies when they match. With `redraft`, replies that fail the review are
    revised (see `plans.revision`; the text is in `draft`).
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    classed = C.classify(mails, ladder=ladder)
    wants_account = C.needs_account(F.col("category"), F.col("body"), account_terms)
    base = classed.select(
        "id", "sender", "subject", "received_at", "category", "priority", "confidence",
        C.route(F.col("category"), F.col("confidence"), settings).alias("route"),
        wants_account.alias("wants_account"),
        G.customer_name(F.col("sender"), F.col("body")).alias("name"),
        G.feedback_digest(F.col("body")).alias("digest"),
    )
    texts = A.one_per_address(accounts).select(
        F.col("email").alias("sender"), A.account_summary(now).alias("account_context"))
    # mails that need no account get a key of their own: NULL keys would all meet in one task
    asks = base.withColumn(
        "lookup", F.when((F.col("route") == "process") & F.col("wants_account"), F.col("sender"))
        .otherwise(F.concat(F.lit("no lookup: "), F.col("id"))))
    rows = asks.join(texts.withColumnRenamed("sender", "lookup"), "lookup", "left").drop("lookup")

    searched = classed.filter(C.route(F.col("category"), F.col("confidence"), settings) == "process")
    if not settings.retrieve_for_inquiry:
        searched = searched.filter("category <> 'product_inquiry'")
    docs = dual_documents(searched.select("id", "subject", "body"), kb)
    rows = rows.join(docs, "id", "left").withColumns({
        "document_context": F.array_join(F.transform("docs", lambda d: d["content"]), "\n\n"),
        "docs_retrieved": F.when(F.col("account_context").isNull(), F.coalesce(F.size("docs"), F.lit(0)))
        .otherwise(1),
    })
    rows = rows.withColumns({
        "context": F.coalesce("account_context", "document_context", F.lit("")),
        "context_from": F.when(F.col("route") != "process", F.lit("none"))
        .when(F.col("account_context").isNotNull(), F.lit("database"))
        .when(F.col("docs").isNotNull(), F.lit("documents")).otherwise(F.lit("none")),
    }).drop("docs", "account_context", "document_context", "wants_account")

    rows = _with_reply(rows, mails, cache, replies, now, settings)
    if redraft is None:
        reviewed = Q.review(rows, "draft").withColumn("revision_count", F.lit(0))
    else:
        rows = materialise(rows, "drafts")
        answered = F.col("route") == "process"
        others = Q.review(rows.where(~answered), "draft").withColumn("revision_count", F.lit(0))
        reviewed = RV.revise(rows.where(answered), redraft, "draft", settings).unionByName(others)
    reviewed = reviewed.withColumn("route_ok", F.col("route") == "process")
    approved = F.when(F.col("route") == "feedback", F.lit(True)).when(F.col("route_ok"), F.col("approved")).otherwise(False)
    score = (
        F.when(F.col("route") == "feedback", F.lit(10.0)).when(F.col("route_ok"), F.col("quality_score")).otherwise(0.0)
    )
    draft = F.when(F.col("route_ok"), F.col("redacted_reply")).otherwise(F.col("draft"))
    results = reviewed.select(
        "id", "sender", "subject", "received_at", "category", "priority", "confidence", "route",
        "context_from", "docs_retrieved", "used_cache", "digest", "name", "revision_count",
        J.final_status(F.col("route"), F.col("approved")).alias("status"),
        score.alias("qa_score"), approved.alias("qa_approved"),
        F.when(F.col("route_ok"), F.col("requires_redaction")).otherwise(False).alias("response_redacted"),
        F.when(F.col("route_ok"), F.col("issues")).alias("qa_issues"),
        F.when(F.col("route_ok"), F.col("safety_violations")).alias("safety_violations"),
        F.when(F.col("route") == "skip", F.lit("")).otherwise(draft).alias("final_response"),
        draft.alias("draft_response"),
        (F.col("route") == "feedback").alias("feedback_saved"),
        F.when(F.col("route") == "feedback", F.concat_ws(
            " | ", "name", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss"), "digest")).alias("feedback_line"),
    )
    return J.decide_action(results)


def _with_reply(rows, mails, cache, replies, now, settings):
    """Draft per row: cached reply, supplied model text, or the fixed wording."""
    sign = lambda c: G.add_signature(c, settings)
    answer = F.concat(
        F.lit("Dear "), F.col("name"), F.lit(",\n\nThank you for your message about "), F.col("subject"),
        F.lit(".\n\n"), G.context_or_default(F.col("context")), F.lit("\n\n" + CLOSING))
    thanks = F.concat(F.lit("Dear "), F.col("name"), F.lit(",\n\n" + THANKS + "\n\n" + CLOSING))
    if replies is not None:
        supplied = G.clean_replies(replies.select("id", F.col("reply").alias("supplied")), "supplied")
        rows = rows.join(supplied, "id", "left")
        answer = F.coalesce("supplied", answer)
        thanks = F.coalesce("supplied", thanks)
    written = sign(F.when(F.col("route") == "feedback", thanks).otherwise(answer))
    if cache is None:
        return rows.withColumns({"draft": written, "used_cache": F.lit(False)})
    process = mails.select("id", "subject", "body").join(
        rows.filter("route = 'process'").select("id", "category"), "id")
    hits = I.lookup(process, cache, now, settings)
    hits = I.reuse_gate(hits, F.lit(0), settings).select("id", F.col("response").alias("cached"))
    out = rows.join(hits, "id", "left")
    return out.withColumns({
        "draft": F.coalesce("cached", written), "used_cache": F.col("cached").isNotNull()}).drop("cached")


def cache_writes(results: DataFrame, mails: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cache rows of freshly approved, unrevised replies."""
    answered = results.filter("route = 'process' AND NOT used_cache").withColumn("approved", F.col("qa_approved"))
    fresh = I.write_gate(answered).select(
        "id", "category", F.col("final_response").alias("response"), "qa_score", F.col("received_at").alias("ts"))
    return I.cache_rows(fresh.join(mails.select("id", "subject", "body"), "id"), settings)


def metrics(results: DataFrame) -> DataFrame:
    """Metrics record per mail, timings filled in by the caller where measured."""
    zero = F.lit(0.0)
    return results.select(
        F.col("id").alias("email_id"), "category", "priority", zero.alias("total_time"),
        zero.alias("classification_time"), zero.alias("retrieval_time"), zero.alias("generation_time"),
        zero.alias("qa_time"), "qa_score", "qa_approved", "revision_count",
        "docs_retrieved", "used_cache", F.lit(False).alias("used_reranking"),
        F.lit(False).alias("used_hybrid"), "status")


