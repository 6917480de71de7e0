"""Reply-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskspark import rules as R
from deskspark.operators import reply as G
from deskspark.registry import register
from deskspark.registry.classify import CLASSED_SQL, classed
from deskspark.registry.mail import BODY_NORM_SQL
from deskspark.registry.views import any_contains, drafts, mails, msgs, sql_strip, with_ctes
from deskspark.settings import DEFAULTS


def _template_sql() -> str:
    def filled(template: str) -> str:
        expr = "'" + template.replace("\n", "' || chr(10) || '") + "'"
        slots = {"sender": "sender", "subject": "subject", "body": "body",
                 "context": "'" + R.SLOT_DEFAULTS["context"] + "'"}
        for name, col in slots.items():
            expr = expr.replace("{" + name + "}", f"' || {col} || '")
        return expr

    arms = " ".join(f"WHEN '{k}' THEN {filled(t)}" for k, t in R.TEMPLATES.items() if k)
    return f"CASE category {arms} ELSE {filled(R.TEMPLATES[''])} END"


@register("render_template", CLASSED_SQL + f"SELECT id, {_template_sql()} AS prompt FROM classed")
def render_template(spark, sf_dir):
    c = classed(spark, sf_dir)
    slots = {s: F.col(s) for s in ("sender", "subject", "body")}
    return c.select("id", G.render_template(F.col("category"), slots).alias("prompt"))


@register("prompt_inputs", with_ctes("mails") + """
SELECT id, substr(coalesce(body, ''), 1, 500) AS body, substr(coalesce(subject || chr(10) || body, ''), 1, 800) AS reply,
  substr(coalesce(sender_raw || ' ' || body, ''), 1, 300) AS context FROM mails""")
def prompt_inputs(spark, sf_dir):
    """What a prompt takes of each mail as a body, under its subject as a reply, and after its sender as a context."""
    reply, context = F.concat("subject", F.lit("\n"), "body"), F.concat("sender_raw", F.lit(" "), "body")
    return mails(spark, sf_dir).select("id", G.prompt_inputs(F.col("body"), reply, context).alias("p")).select("id", "p.*")


def _cleanup_sql(src: str) -> str:
    """CTE steps of the cleanup, reading column `reply` of the named CTE."""
    spot = "coalesce(" + ", ".join(
        f"nullif(strpos(reply, '{m}'), 0)" for m in R.SALUTATIONS) + ", 0)"
    off = "least(" + ", ".join(
        f"CASE WHEN strpos(r1, '{m}') > 1 THEN strpos(r1, '{m}') END" for m in R.SIGN_OFFS) + ")"
    ws = "' ' || chr(9) || chr(10) || chr(13)"
    notes = "|".join(R.TRAILING_NOTES)
    body = BODY_NORM_SQL.format("r4")
    return rf""", c1 AS (SELECT *, CASE WHEN {spot} > 101 THEN substr(reply, {spot}) ELSE reply END AS r1 FROM {src}),
c2 AS (SELECT *, {off} AS cut FROM c1),
c3 AS (SELECT *, CASE WHEN cut IS NULL THEN r1 ELSE rtrim(substr(r1, 1, cut - 1), {ws}) END AS r2 FROM c2),
c4 AS (SELECT *, regexp_replace(regexp_replace(r2, '\[Your [^\]]+\]', '', 'g'), '\(optional\)', '', 'g') AS r3 FROM c3),
c5 AS (SELECT *, regexp_replace(r3, '(?is)\n\n({notes}).*$', '') AS r4 FROM c4),
cleaned AS (SELECT *, {sql_strip(f"regexp_replace({body}, '\n{{3,}}', chr(10) || chr(10), 'g')")} AS clean FROM c5)
"""


RAW_SQL = with_ctes("drafts") + """, raw AS (
  SELECT id, CASE WHEN turn % 5 = 0 THEN repeat('Working on it. ', 8) ELSE '' END || reply
    || CASE WHEN turn % 3 = 0 THEN ' [Your Name] (optional)' ELSE '' END
    || CASE WHEN conv_id % 4 = 1 THEN chr(10) || chr(10) || chr(10) || '  please note this is a sketch.' || chr(10) || 'x' ELSE '' END
    || CASE WHEN conv_id % 4 = 2 THEN chr(10) || chr(10) || '--- end' ELSE '' END AS reply
  FROM drafts)
"""


def raw_replies(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    reply = F.concat(
        F.when(turn % 5 == 0, F.repeat(F.lit("Working on it. "), F.lit(8))).otherwise(F.lit("")),
        F.col("reply"),
        F.when(turn % 3 == 0, F.lit(" [Your Name] (optional)")).otherwise(F.lit("")),
        F.when(conv % 4 == 1, F.lit("\n\n\n  please note this is a sketch.\nx")).otherwise(F.lit("")),
        F.when(conv % 4 == 2, F.lit("\n\n--- end")).otherwise(F.lit("")),
    )
    return drafts(spark, sf_dir).select("id", reply.alias("reply"))


@register("reply_cleanup", RAW_SQL + _cleanup_sql("raw") + "SELECT id, clean AS reply FROM cleaned")
def reply_cleanup(spark, sf_dir):
    return G.clean_replies(raw_replies(spark, sf_dir))


def signature_sql(text: str) -> str:
    marks = ["Thanks,", DEFAULTS.team, DEFAULTS.support_address]
    tidy = rf"""regexp_replace(regexp_replace({text}, '(^|\n)[ \t\x{{00A0}}]+', '\1', 'g'), '[ \t]+(\n|$)', '\1', 'g')"""
    sig = DEFAULTS.signature.replace("\n", "' || chr(10) || '")
    return (f"CASE WHEN {any_contains(text, marks)} THEN {tidy} ELSE "
            f"rtrim({tidy}, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '{sig}' END")


@register("add_signature", with_ctes("drafts") + f"""
, d AS (SELECT id, CASE WHEN turn = 1 THEN reply || chr(10) || 'Thanks, Kim  ' ELSE reply || '  ' END AS reply FROM drafts)
SELECT id, {signature_sql('reply')} AS reply FROM d""")
def add_signature(spark, sf_dir):
    reply = F.when(F.col("turn") == 1, F.concat(F.col("reply"), F.lit("\nThanks, Kim  "))).otherwise(
        F.concat(F.col("reply"), F.lit("  "))
    )
    return drafts(spark, sf_dir).select("id", G.add_signature(reply).alias("reply"))


NAME_SQL = r"""coalesce(
  list_filter(list_reverse(list_transform(string_split({body}, chr(10))[-5:], lambda l: """ + sql_strip("l") + r""")),
    lambda l: l <> '' AND NOT regexp_matches(l, '^(Best|Thanks|Regards|Sincerely|-)')
      AND len(regexp_split_to_array(l, '\s+')) <= 3 AND NOT contains(l, '@'))[1],
  nullif(array_to_string(list_transform(
    list_filter(string_split(translate(split_part({sender}, '@', 1), '._-', '   '), ' '), lambda w: w <> ''),
    lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' '), ''), 'Customer')"""


@register("name_extract", with_ctes("mails", "msgs") + f"""
SELECT 'm' || id AS id, {NAME_SQL.format(body='body', sender='sender')} AS name FROM mails
UNION ALL
SELECT 't' || id, {NAME_SQL.format(body="text || chr(10) || 'Best,' || chr(10) || '  Kim ' || role", sender="'x@y.z'")}
FROM msgs""")
def name_extract(spark, sf_dir):
    m = mails(spark, sf_dir).select(
        F.concat(F.lit("m"), F.col("id")).alias("id"),
        G.customer_name(F.col("sender"), F.col("body")).alias("name"),
    )
    signed = F.concat(F.col("text"), F.lit("\nBest,\n  Kim "), F.col("role"))
    t = msgs(spark, sf_dir).select(
        F.concat(F.lit("t"), F.col("id")).alias("id"),
        G.customer_name(F.lit("x@y.z"), signed).alias("name"),
    )
    return m.unionByName(t)


DIGEST_SQL = ("array_to_string(list_filter(list_transform(string_split({0}, '.')[1:3], lambda p: "
              + sql_strip("p") + "), lambda p: p <> ''), '. ') || '.'")


@register("feedback_digest", with_ctes("mails") + f"SELECT id, {DIGEST_SQL.format('body')} AS digest FROM mails")
def feedback_digest(spark, sf_dir):
    return mails(spark, sf_dir).select("id", G.feedback_digest(F.col("body")).alias("digest"))


@register("digest_cleanup", with_ctes("mails") + r"""
, d AS (SELECT id, CASE doc_id % 3 WHEN 0 THEN ' Feedback: "' || subject || '" '
    WHEN 1 THEN 'Extracted feedback/feature: ' || subject ELSE 'Feature:Feedback: ' || subject || '"' END AS raw FROM mails),
t AS (SELECT id, """ + sql_strip("replace(replace(replace(raw, 'Extracted feedback/feature:', ''), 'Feedback:', ''), 'Feature:', '')") + r""" AS c FROM d)
SELECT id, CASE WHEN starts_with(c, '"') AND ends_with(c, '"') THEN substr(c, 2, len(c) - 2) ELSE c END AS digest
FROM t""")
def digest_cleanup(spark, sf_dir):
    kind = F.col("doc_id") % 3
    raw = (
        F.when(kind == 0, F.concat(F.lit(' Feedback: "'), F.col("subject"), F.lit('" ')))
        .when(kind == 1, F.concat(F.lit("Extracted feedback/feature: "), F.col("subject")))
        .otherwise(F.concat(F.lit("Feature:Feedback: "), F.col("subject"), F.lit('"')))
    )
    return mails(spark, sf_dir).select("id", G.clean_digest(raw).alias("digest"))


@register("feedback_log", CLASSED_SQL + f"""
SELECT id, category, {NAME_SQL.format(body='body', sender='sender')} || ' | ' ||
  strftime(received_at, '%Y-%m-%d %H:%M:%S') || ' | ' || {DIGEST_SQL.format('body')} AS line
FROM classed WHERE category IN ('feedback', 'feature_request')""")
def feedback_log(spark, sf_dir):
    c = classed(spark, sf_dir).filter(F.col("category").isin(*R.FEEDBACK_CATEGORIES))
    return G.feedback_lines(c, F.col("received_at"))
