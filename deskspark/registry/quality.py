"""Safety and quality queries on reply drafts and mail texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark.operators import quality as Q
from deskspark.registry import register
from deskspark.registry.views import any_contains, drafts, mails, table, values_list, with_ctes
from deskspark.settings import DEFAULTS

PII = {kind: pattern for kind, pattern, _, _ in R.PII_PATTERNS}


def _hit(kind: str, text: str) -> str:
    return f"regexp_matches({text}, '{PII[kind]}')"


def pii_list_sql(text: str) -> str:
    items = ", ".join(
        f"CASE WHEN {_hit(k, text)} THEN 'PII detected: {k}' END" for k in PII)
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def redact_sql(text: str) -> str:
    expr = text
    for kind, pattern, token, _ in R.PII_PATTERNS:
        expr = f"CASE WHEN {_hit(kind, text)} THEN regexp_replace({expr}, '{pattern}', '{token}', 'g') ELSE {expr} END"
    return expr


def toxic_found_sql(text: str) -> str:
    return f"list_filter({values_list(R.TOXIC_TERMS)}, lambda w: contains(lower({text}), w))"


def toxic_list_sql(text: str) -> str:
    found = toxic_found_sql(text)
    return (f"CASE WHEN len({found}) >= 2 THEN ['Unprofessional terms detected: ' || array_to_string(({found})[1:2], ', ')] "
            f"WHEN len({found}) = 1 THEN ['Unprofessional language: ' || ({found})[1]] ELSE [] END")


def other_list_sql(text: str) -> str:
    found = f"list_filter({values_list(R.PLACEHOLDERS)}, lambda w: contains(upper({text}), w))"
    return (f"list_filter([CASE WHEN len({found}) > 0 THEN 'Contains placeholder text: ' || array_to_string({found}, ', ') END, "
            f"CASE WHEN len(trim({text}, ' ' || chr(10))) < 50 THEN 'Response is too short (< 50 chars)' END], lambda v: v IS NOT NULL)")


def violations_sql(text: str) -> str:
    return f"list_concat(list_concat({pii_list_sql(text)}, {toxic_list_sql(text)}), {other_list_sql(text)})"


def blocked_sql(text: str) -> str:
    found = f"len(list_filter({values_list(R.PLACEHOLDERS)}, lambda w: contains(upper({text}), w))) > 0"
    return f"({_hit('CREDIT_CARD', text)} OR {_hit('US_SSN', text)} OR {found})"


TEXTS_SQL = with_ctes("mails", "drafts") + """, texts AS (
  SELECT 'm' || id AS id, body AS text FROM mails UNION ALL SELECT 'd' || id, reply FROM drafts)
"""


def texts(spark, sf_dir):
    m = mails(spark, sf_dir).select(F.concat(F.lit("m"), F.col("id")).alias("id"), F.col("body").alias("text"))
    d = drafts(spark, sf_dir).select(F.concat(F.lit("d"), F.col("id")).alias("id"), F.col("reply").alias("text"))
    return m.unionByName(d)


@register("pii_detect", TEXTS_SQL + f"""
SELECT id, array_to_string({pii_list_sql('text')}, '; ') AS violations FROM texts""")
def pii_detect(spark, sf_dir):
    found = Q.messages(Q.pii_violations(F.col("text")))
    return texts(spark, sf_dir).select("id", F.array_join(found, "; ").alias("violations"))


@register("pii_redact", TEXTS_SQL + f"SELECT id, {redact_sql('text')} AS redacted FROM texts")
def pii_redact(spark, sf_dir):
    return texts(spark, sf_dir).select("id", Q.redact(F.col("text")).alias("redacted"))


def _extended_sql() -> str:
    arms = "\nUNION ALL\n".join(
        f"SELECT id, '{kind}' AS kind, '{severity}' AS severity, regexp_extract_all(text, '{pattern}', 0) AS hits FROM texts"
        for kind, pattern, severity in R.PII_EXTENDED_PATTERNS)
    return TEXTS_SQL + f""", h AS ({arms})
SELECT id, kind, severity, unnest(range(len(hits)))::INTEGER AS pos, unnest(hits) AS hit FROM h WHERE len(hits) > 0"""


@register("pii_extended", _extended_sql())
def pii_extended(spark, sf_dir):
    return Q.pii_hits(texts(spark, sf_dir), "id", "text")


@register("toxic_terms", TEXTS_SQL + f"""
SELECT id, array_to_string({toxic_list_sql('text')}, '; ') AS message,
  CASE WHEN len({toxic_found_sql('text')}) >= 2 THEN 'high' WHEN len({toxic_found_sql('text')}) = 1 THEN 'medium'
  ELSE 'none' END AS severity FROM texts""")
def toxic_terms(spark, sf_dir):
    v = Q.toxic_violations(F.col("text"))
    return texts(spark, sf_dir).select(
        "id", F.array_join(Q.messages(v), "; ").alias("message"),
        F.coalesce(F.get(v, F.lit(0))["severity"], F.lit("none")).alias("severity"),
    )


LABEL_SQL = """, v AS (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'severe ' WHEN toxic = 1 THEN 'MODERATE'
  WHEN quality = 0 THEN 'Mild' ELSE 'SAFE' END AS label FROM labels)"""


def label_column():
    return (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit("severe "))
        .when(F.col("toxic") == 1, F.lit("MODERATE")).when(F.col("quality") == 0, F.lit("Mild"))
        .otherwise(F.lit("SAFE"))
    )


@register("toxic_verdict", "WITH" + LABEL_SQL[1:] + """
SELECT doc_id, CASE upper(trim(label)) WHEN 'SEVERE' THEN 'critical' WHEN 'MODERATE' THEN 'high'
  WHEN 'MILD' THEN 'medium' ELSE 'none' END AS severity,
  CASE upper(trim(label)) WHEN 'SEVERE' THEN 'block' WHEN 'MODERATE' THEN 'block'
  WHEN 'MILD' THEN 'flag' ELSE 'none' END AS action,
  CASE upper(trim(label)) WHEN 'SEVERE' THEN 'Severe toxic language detected' WHEN 'MODERATE' THEN 'Moderate toxic language detected'
  WHEN 'MILD' THEN 'Mild unprofessional language detected' ELSE 'none' END AS message
FROM v""")
def toxic_verdict(spark, sf_dir):
    v = F.get(Q.toxic_verdict(label_column()), F.lit(0))
    return table(spark, sf_dir, "labels").select(
        "doc_id", *[F.coalesce(v[f], F.lit("none")).alias(f) for f in ("severity", "action", "message")]
    )


@register("topic_verdict", with_ctes("mails") + """
SELECT m.id, CASE WHEN l.quality = 0 AND len(m.body) > 20
  THEN 'Response appears off-topic for category: ' || lang END AS message
FROM mails m JOIN labels l USING (doc_id)""")
def topic_verdict(spark, sf_dir):
    m = mails(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    verdict = F.when(F.col("quality") == 0, F.lit("off_topic")).otherwise(F.lit("RELEVANT"))
    v = Q.topic_violations(verdict, F.col("body"), F.col("lang"))
    return m.select("id", F.get(v, F.lit(0))["message"].alias("message"))


@register("placeholder_check", with_ctes("drafts") + f"""
SELECT id, array_to_string({other_list_sql('reply')}, '; ') AS message FROM drafts""")
def placeholder_check(spark, sf_dir):
    return drafts(spark, sf_dir).select(
        "id", F.array_join(Q.messages(Q.other_violations(F.col("reply"))), "; ").alias("message")
    )


@register("violations", with_ctes("drafts") + f"""
, v AS (SELECT id, {violations_sql('reply')} AS list FROM drafts)
SELECT id, unnest(range(len(list)))::INTEGER AS pos, unnest(list) AS message FROM v""")
def violations(spark, sf_dir):
    v = Q.messages(Q.all_violations(F.col("reply")))
    return drafts(spark, sf_dir).select("id", F.posexplode(v).alias("pos", "message"))


@register("block_decision", with_ctes("drafts") + f"""
SELECT id, {blocked_sql('reply')} AS should_block FROM drafts""")
def block_decision(spark, sf_dir):
    return drafts(spark, sf_dir).select(
        "id", Q.must_block(Q.all_violations(F.col("reply"))).alias("should_block")
    )


ISSUES = '["Tone could be warmer"]'


@register("qa_override", with_ctes("drafts") + f"""
, m AS (SELECT id, turn % 5 <> 4 AS approved, CAST(turn % 11 AS DOUBLE) AS score,
    {violations_sql('reply')} AS v, {blocked_sql('reply')} AS blocked FROM drafts)
SELECT id, approved AND NOT blocked AS approved,
  CASE WHEN blocked THEN 0.0 WHEN len(v) > 0 THEN least(score, 7.0) ELSE score END AS quality_score,
  array_to_string(CASE WHEN NOT blocked THEN list_concat(['Tone could be warmer'], v) ELSE ['Tone could be warmer'] END, '; ') AS issues,
  CASE WHEN blocked THEN '{R.BLOCK_REASON}' ELSE 'r' END AS reasoning
FROM m""")
def qa_override(spark, sf_dir):
    qa = F.struct(
        (F.col("turn") % 5 != 4).alias("approved"), (F.col("turn") % 11).cast("double").alias("quality_score"),
        F.array(F.lit("Tone could be warmer")).alias("issues"), F.array().cast("array<string>").alias("suggestions"),
        F.lit("t").alias("tone_assessment"), F.lit("r").alias("reasoning"),
    )
    d = drafts(spark, sf_dir).withColumn("v", Q.all_violations(F.col("reply")))
    out = d.withColumn("qa", Q.apply_safety(qa, F.col("v")))
    return out.select("id", "qa.approved", "qa.quality_score",
                      F.array_join("qa.issues", "; ").alias("issues"), "qa.reasoning")


def quality_cte(src: str = "drafts") -> str:
    """CTE `scored`: the rule-based score of each reply."""
    esc = any_contains("lower(reply)", R.QA_ESCALATION_TERMS)
    emp = any_contains("lower(reply)", R.EMPATHY_TERMS)
    greet = " OR ".join(
        f"starts_with(reply, '{g}') OR contains(substr(reply, 1, 100), chr(10) || '{g}')" for g in R.GREETINGS)
    return f""", q0 AS (SELECT *, {violations_sql('reply')} AS v, {esc} AS esc, len(reply) < 80 AS brief, len(reply) > 3000 AS long,
    NOT ({greet}) AS nogreet, NOT {emp} AND len(reply) > 100 AS cold, NOT contains(lower(reply), '{R.CLOSING_LINE}') AS noclose FROM {src}),
q1 AS (SELECT *, greatest(0.0, round(8.0 - CASE WHEN brief THEN 3.0 WHEN long THEN 1.5 ELSE 0 END
    - CASE WHEN nogreet THEN 0.8 ELSE 0 END - CASE WHEN cold THEN 0.7 ELSE 0 END
    - CASE WHEN noclose THEN 1.0 ELSE 0 END - 2.0 * len(v), 1)) AS s,
  list_concat(list_filter([CASE WHEN brief THEN 'Response too brief' WHEN long THEN 'Response very long' END,
    CASE WHEN nogreet THEN 'Missing greeting' END, CASE WHEN cold THEN 'Could show more empathy' END,
    CASE WHEN noclose THEN 'Missing required closing' END], lambda x: x IS NOT NULL), v) AS issue_list,
  list_filter([CASE WHEN brief THEN 'Expand with specific steps or information' END,
    CASE WHEN noclose THEN 'End with ''Hope you have a great day!''' END], lambda x: x IS NOT NULL) AS suggestion_list FROM q0),
scored AS (SELECT * EXCLUDE (v), v AS viol, esc OR (s >= 7.0 AND len(v) = 0) AS approved,
  CAST(CASE WHEN esc THEN 9.0 ELSE s END AS DOUBLE) AS quality_score,
  CASE WHEN esc THEN [] ELSE issue_list END AS issues, CASE WHEN esc THEN [] ELSE suggestion_list END AS suggestions FROM q1)
"""


@register("quality_score", with_ctes("drafts") + quality_cte() + """
SELECT id, approved, quality_score, array_to_string(issues, '; ') AS issues,
  array_to_string(suggestions, '; ') AS suggestions, array_to_string(viol, '; ') AS safety FROM scored""")
def quality_score(spark, sf_dir):
    r = Q.review(drafts(spark, sf_dir))
    return r.select(
        "id", "approved", "quality_score", F.array_join("issues", "; ").alias("issues"),
        F.array_join("suggestions", "; ").alias("suggestions"),
        F.array_join("safety_violations", "; ").alias("safety"),
    )


@register("qa_intake", with_ctes("drafts") + quality_cte() + f"""
, j AS (SELECT *, conv_id % 3 = 0 AS good, {blocked_sql('reply')} AS blocked, CAST(turn % 11 AS DOUBLE) AS ms FROM scored)
SELECT id, good AS qa_from_model, CASE WHEN good THEN NOT blocked ELSE approved END AS approved,
  CASE WHEN NOT good THEN quality_score WHEN blocked THEN 0.0 WHEN len(viol) > 0 THEN least(ms, 7.0) ELSE ms END AS quality_score,
  good AND blocked AS should_block, good AND ({redact_sql('reply')}) <> reply AS requires_redaction FROM j""")
def qa_intake(spark, sf_dir):
    """Model JSON rows: good ones, out-of-range ones and broken ones."""
    answer = F.concat(
        F.lit('{"approved": true, "quality_score": '),
        F.when(F.col("conv_id") % 3 == 1, F.lit("77")).otherwise((F.col("turn") % 11).cast("string")),
        F.lit(', "issues": [], "suggestions": [], "tone_assessment": "t", "reasoning": "r"'),
        F.when(F.col("conv_id") % 3 == 2, F.lit("")).otherwise(F.lit("}")),
    )
    r = Q.review(drafts(spark, sf_dir).withColumn("answer", answer), model_json="answer")
    return r.select("id", "qa_from_model", "approved", "quality_score", "should_block", "requires_redaction")


@register("needs_revision", with_ctes("drafts") + quality_cte() + """
SELECT id, NOT approved OR quality_score < 7.0 AS needs_revision FROM scored""")
def needs_revision(spark, sf_dir):
    r = Q.review(drafts(spark, sf_dir))
    return r.select("id", Q.needs_revision(F.col("approved"), F.col("quality_score")).alias("needs_revision"))


def _numbered(items: str, heading: str) -> str:
    return (f"CASE WHEN len({items}) > 0 THEN {heading} || "
            f"array_to_string(list_transform({items}, lambda x, i: i || '. ' || x || chr(10)), '') ELSE '' END")


@register("revision_note", with_ctes("drafts") + quality_cte() + f"""
SELECT id, 'Please revise the response to address the following issues:' || chr(10) || chr(10) ||
  {_numbered('issues', "'Issues to fix:' || chr(10)")} ||
  {_numbered('suggestions', "chr(10) || 'Suggestions for improvement:' || chr(10)")} AS note FROM scored""")
def revision_note(spark, sf_dir):
    r = Q.review(drafts(spark, sf_dir))
    return r.select("id", Q.revision_note(F.col("issues"), F.col("suggestions")).alias("note"))


def _quick_sql() -> str:
    p = DEFAULTS.product
    items = ["CASE WHEN len(reply) < 50 THEN 'Response is too short' END",
             "CASE WHEN len(reply) > 3000 THEN 'Response is very long' END"]
    items += [f"CASE WHEN contains(lower(reply), '{m.lower()}') THEN 'Contains placeholder text: {m}' END"
              for m in R.QUICK_PLACEHOLDERS]
    items += [f"CASE WHEN NOT contains(lower(reply), '{R.CLOSING_LINE}') THEN 'Missing required closing: ''Hope you have a great day!''' END",
              f"CASE WHEN contains(lower(reply), '{p.lower()}') AND NOT contains(reply, '{p}') THEN 'Product name should be capitalized: ''{p}''' END"]
    return with_ctes("drafts") + f"""
, d AS (SELECT id, CASE WHEN turn % 4 = 3 THEN 'In acme desk: ' || reply ELSE reply END AS reply FROM drafts),
q AS (SELECT id, list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) AS issues FROM d)
SELECT id, len(issues) = 0 AS passed, array_to_string(issues, '; ') AS issues FROM q"""


@register("quick_check", _quick_sql())
def quick_check(spark, sf_dir):
    reply = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("In acme desk: "), F.col("reply"))).otherwise(F.col("reply"))
    d = drafts(spark, sf_dir).select("id", Q.quick_check(reply).alias("q"))
    return d.select("id", "q.passed", F.array_join("q.issues", "; ").alias("issues"))


@register("score_bands", with_ctes("drafts") + quality_cte() + """
SELECT CASE WHEN quality_score >= 8 THEN 'approve' WHEN quality_score >= 7 THEN 'approve_with_notes' ELSE 'review' END AS band,
  count(*) AS replies, round(avg(quality_score), 6) AS avg_score FROM scored GROUP BY 1""")
def score_bands(spark, sf_dir):
    r = Q.review(drafts(spark, sf_dir))
    return r.groupBy(Q.score_band(F.col("quality_score")).alias("band")).agg(
        F.count("*").alias("replies"), F.round(F.avg("quality_score"), 6).alias("avg_score")
    )
