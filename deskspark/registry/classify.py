"""Classification and routing queries.

The given texts are invented, so beside the default word lists the queries run the same rules
with words that do occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark.operators import classify as C
from deskspark.registry import register
from deskspark.registry.views import any_contains, drafts, mails, table, with_ctes

FITTED = (
    R.LadderRule("technical_support", ("trash", "ouan", "chkeit"), 0.7, "t", "medium", ("idiot", "elle")),
    R.LadderRule("billing", ("stupid", "license", "hationre"), 0.75, "b", "medium", ("hate", "und")),
    R.LadderRule("feature_request", ("idiot", "thre"), 0.45, "f", "low"),
    R.LadderRule("feedback", ("hate", "great", "que"), 0.65, "k", "low"),
    R.LadderRule("unrelated", ("ción",), 0.9, "u", "low"),
)


def ladder_sql(prefix: str, ladder, fallback, text: str = "t") -> str:
    """CASE columns of a ladder over the lower-cased text expression."""
    def case(pick):
        arms = " ".join(f"WHEN {any_contains(text, r.terms)} THEN {pick(r)}" for r in ladder)
        return f"CASE {arms} ELSE {pick(fallback)} END"

    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    def priority(r):
        if not r.high_terms:
            return quoted(r.priority)
        return f"CASE WHEN {any_contains(text, r.high_terms)} THEN 'high' ELSE {quoted(r.priority)} END"

    def first(r):
        if not r.terms:
            return "NULL"
        return "CASE " + " ".join(
            f"WHEN contains({text}, {quoted(w)}) THEN {quoted(w)}" for w in r.terms
        ) + " END"

    return (
        f"{case(lambda r: quoted(r.category))} AS {prefix}category, "
        f"{case(priority)} AS {prefix}priority, "
        f"CAST({case(lambda r: str(r.confidence))} AS DOUBLE) AS {prefix}confidence, "
        f"{case(first)} AS {prefix}first_hit"
    )


TEXT_SQL = with_ctes("mails") + ", x AS (SELECT *, lower(subject) || ' ' || lower(body) AS t FROM mails)\n"
CLASSED_SQL = TEXT_SQL + f""", classed AS (
  SELECT id, doc_id, sender, subject, body, received_at, {ladder_sql('', FITTED, R.LADDER_DEFAULT)} FROM x)
"""


def classed(spark, sf_dir):
    return C.classify(mails(spark, sf_dir), ladder=FITTED)


@register("classify_keywords", TEXT_SQL + f"""
SELECT id, {ladder_sql('', R.LADDER, R.LADDER_DEFAULT)}, {ladder_sql('fit_', FITTED, R.LADDER_DEFAULT)}
FROM x""")
def classify_keywords(spark, sf_dir):
    cols = ["category", "priority", "confidence", "first_hit"]
    m = mails(spark, sf_dir)
    own = C.keyword_class(F.col("subject"), F.col("body"))
    fit = C.keyword_class(F.col("subject"), F.col("body"), ladder=FITTED)
    return m.withColumns({"own": own, "fit": fit}).select(
        "id", *[F.col(f"own.{c}").alias(c) for c in cols],
        *[F.col(f"fit.{c}").alias(f"fit_{c}") for c in cols],
    )


@register("category_counts", CLASSED_SQL + """
SELECT category, priority, count(*) AS mails FROM classed GROUP BY category, priority""")
def category_counts(spark, sf_dir):
    return classed(spark, sf_dir).groupBy("category", "priority").agg(F.count("*").alias("mails"))


@register("process_gate", CLASSED_SQL + """
SELECT id, category, confidence FROM classed WHERE category <> 'unrelated' AND confidence >= 0.5""")
def process_gate(spark, sf_dir):
    return C.process_gate(classed(spark, sf_dir)).select("id", "category", "confidence")


@register("route", CLASSED_SQL + """
SELECT id, category, CASE WHEN category IN ('feedback', 'feature_request') THEN 'feedback'
  WHEN category <> 'unrelated' AND confidence >= 0.5 THEN 'process' ELSE 'skip' END AS route
FROM classed""")
def route(spark, sf_dir):
    c = classed(spark, sf_dir)
    return c.select("id", "category", C.route(F.col("category"), F.col("confidence")).alias("route"))


@register("classify_intake", TEXT_SQL + f""", l AS (
  SELECT x.*, quality, toxic, {ladder_sql('', FITTED, R.LADDER_DEFAULT)}
  FROM x LEFT JOIN labels USING (doc_id))
SELECT id,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'billing' ELSE category END AS category,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'low' ELSE priority END AS priority,
  CAST(CASE WHEN quality = 1 AND toxic = 0 THEN 0.9 ELSE confidence END AS DOUBLE) AS confidence,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'model' ELSE 'rules' END AS class_origin
FROM l""")
def classify_intake(spark, sf_dir):
    """Model JSON derived from labels: valid, broken, unknown category, out of range, missing."""
    lab = table(spark, sf_dir, "labels")
    good = '{"category": "billing", "priority": "low", "confidence": 0.9, "reasoning": "r"}'
    unknown = '{"category": "sales", "priority": "low", "confidence": 0.9, "reasoning": "r"}'
    ranged = '{"category": "billing", "priority": "low", "confidence": 7, "reasoning": "r"}'
    answer = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(good))
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit("{broken"))
        .when(F.col("toxic") == 1, F.lit(unknown))
        .when(F.col("toxic") == 0, F.lit(ranged))
    )
    m = mails(spark, sf_dir).join(lab, "doc_id", "left").withColumn("answer", answer)
    out = C.classify_with_model(m, "answer", ladder=FITTED)
    return out.select("id", "category", "priority", "confidence", "class_origin")


@register("needs_account", CLASSED_SQL + f"""
SELECT id, category = 'billing' OR {any_contains('lower(body)', R.ACCOUNT_TERMS)} AS own_terms,
  category = 'billing' OR {any_contains('lower(body)', ['tier', 'ment', 'ption'])} AS needs_account
FROM classed""")
def needs_account(spark, sf_dir):
    c = classed(spark, sf_dir)
    cat, body = F.col("category"), F.col("body")
    return c.select(
        "id", C.needs_account(cat, body).alias("own_terms"),
        C.needs_account(cat, body, ["tier", "ment", "ption"]).alias("needs_account"),
    )


@register("escalation", with_ctes("drafts") + f"""
SELECT id, {any_contains('lower(reply)', R.ESCALATION_TERMS)} AS is_escalation FROM drafts""")
def escalation(spark, sf_dir):
    return drafts(spark, sf_dir).select("id", C.has_escalation(F.col("reply")).alias("is_escalation"))
