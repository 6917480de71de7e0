import pytest
from hypothesis import HealthCheck, given, settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskspark.operators import quality as Q
from deskspark.operators import reply as G
from deskspark.settings import DEFAULTS


def each(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def cleaned(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, reply string")
    return [r.reply for r in G.clean_replies(df).orderBy("i").collect()]


def test_cleanup(spark):
    pad = "x" * 101
    got = cleaned(spark, [
        pad + "Hello you",                                  # cut before a late salutation
        "x" * 100 + "Hello you",                            # at position 100 it stays
        pad + "Thank you for this. Dear Kim",               # list order: 'Dear ' decides
        "Hi Kim\n\n\n  a  \nBest regards,\nSam\nThanks,",    # earliest sign-off
        "Thanks, x",                                        # a sign-off that opens the text is kept
        "Hi\nsee [Your Name here] (optional)\n\nnote: internal\n\nmore",
        "Hi\n\n--- cut\nx",
    ])
    assert got == [
        "Hello you", "x" * 100 + "Hello you", "Dear Kim", "Hi Kim\n\na", "Thanks, x", "Hi\nsee", "Hi",
    ]


def test_signature(spark):
    got = each(spark, ["Hi \n", "Hi\nThanks, Kim ", f"from {DEFAULTS.support_address}"], G.add_signature)
    assert got == ["Hi\n\n" + DEFAULTS.signature, "Hi\nThanks, Kim", f"from {DEFAULTS.support_address}"]


def test_name(spark):
    df = spark.createDataFrame([
        ("a.b_c-d@x", "one line with many words\n"), ("x@y", "Bye\n- Kim"), ("x@y", "\n\n"), ("@y", "mail me a@b"),
        ("x@y", "Name\n1 2 3 4\n1 2 3 4\n1 2 3 4\n1 2 3 4\n1 2 3 4"), ("JOHN@y", ""),
    ], "s string, b string")
    got = [r[0] for r in df.select(G.customer_name(F.col("s"), F.col("b"))).collect()]
    assert got == ["A B C D", "Bye", "X", "Customer", "X", "John"]


def test_digests(spark):
    assert each(spark, ["a. b.. c. d", "", "no stop"], G.feedback_digest) == ["a. b.", ".", "no stop."]
    assert each(spark, [' Feedback: "x" ', "Feature: y", '"'], G.clean_digest) == ["x", "y", ""]


def test_template(spark):
    df = spark.createDataFrame([("billing", "s {body}", "b"), ("other", None, None)], "c string, s string, b string")
    slots = {"subject": F.col("s"), "body": F.col("b")}
    templates = {"billing": "{subject}|{body}|{context}", "": "{subject}/{body}/{sender}"}
    got = [r[0] for r in df.select(G.render_template(F.col("c"), slots, templates)).collect()]
    assert got == ["s {body}|b|No further context is available.", "Your inquiry//Valued Customer"]


def test_redaction_oddities(spark):
    got = each(spark, ["(555)123-4567", "+1-555-123-4567", "4111-1111-1111-1111", "123-45-6789", "plain"], Q.redact)
    assert got == ["([PHONE REDACTED]", "+[PHONE REDACTED]", "[CARD REDACTED]", "[SSN REDACTED]", "plain"]


@hyp(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789-(). ab\n", max_size=40), min_size=20, max_size=40))
def test_redaction_is_idempotent(spark, texts):
    once = each(spark, texts, Q.redact)
    twice = each(spark, once, Q.redact)
    again = each(spark, twice, Q.redact)
    assert twice == again


def test_violations_order_and_block(spark):
    text = "stupid idiot 4111 1111 1111 1111 [TODO]"
    df = spark.createDataFrame([(text,), ("a" * 60 + " dumb",), ("555-123-4567 " + "y" * 60,)], "r string")
    v = Q.all_violations(F.col("r"))
    rows = df.select(Q.messages(v).alias("m"), Q.must_block(v).alias("b")).collect()
    assert rows[0].m == ["PII detected: CREDIT_CARD", "Unprofessional terms detected: stupid, idiot",
                         "Contains placeholder text: [TODO", "Response is too short (< 50 chars)"]
    assert [r.b for r in rows] == [True, False, False]
    assert rows[1].m == ["Unprofessional language: dumb"]


def test_supplied_verdicts(spark):
    df = spark.createDataFrame([("severe", "OFF_TOPIC"), (None, None)], "t string, o string").withColumn("r", F.lit("stupid " * 9))
    topic = Q.topic_violations(F.col("o"), F.col("r"), F.lit("billing"))
    v = Q.all_violations(F.col("r"), F.col("t"), topic)
    rows = [r[0] for r in df.select(Q.messages(v)).collect()]
    assert rows[0] == ["Severe toxic language detected", "Response appears off-topic for category: billing"]
    assert rows[1] == ["Unprofessional language: stupid"]


@pytest.mark.parametrize("reply,approved,score", [
    ("Dear Kim, " + "we understand. " * 8 + "Hope you have a great day!", True, 8.0),
    ("We understand. " * 8 + "Hope you have a great day!", True, 7.2),
    ("Dear Kim, " + "we understand. " * 8, True, 7.0),
    ("text " * 30, False, 5.5),
    ("short", False, 1.2),
    ("short but a specialist helps", True, 9.0),
    ("Dear Kim, we understand. stupid " + "z" * 60 + " hope you have a great day", False, 6.0),
    ("Dear Kim, we understand. Hope you have a great day! " + "w " * 1600, False, 6.5),
])
def test_quality(spark, reply, approved, score):
    r = Q.review(spark.createDataFrame([(reply,)], "reply string")).first()
    assert (r.approved, r.quality_score) == (approved, score)


def test_revision_note(spark):
    df = spark.createDataFrame([(["a", "b"], ["c"]), ([], [])], "i array<string>, s array<string>")
    got = [r[0] for r in df.select(Q.revision_note(F.col("i"), F.col("s"))).collect()]
    head = "Please revise the response to address the following issues:\n\n"
    assert got == [head + "Issues to fix:\n1. a\n2. b\n\nSuggestions for improvement:\n1. c\n", head]
