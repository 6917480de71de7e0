"""Default word lists on mails of our own, shaped after ordinary and safety cases."""

import pytest
from pyspark.sql import functions as F

from deskspark.operators import classify as C
from deskspark.operators import quality as Q
from deskspark.operators import reply as G
from deskspark.rules import TOXIC_TERMS

# id, subject, body, category, priority, confidence, first hit, account, toxic terms, pii kinds, name
GOLDEN = [
    ("tech", "Login trouble", "My password is refused, this is urgent.\n\nBest,\nJohn",
     "technical_support", "high", 0.7, "login", False, 0, "", "John"),
    ("cannot", "Export", "I can't export.\nThanks!\nSecurity Team\nacme",
     "technical_support", "medium", 0.7, "can't", False, 0, "", "acme"),
    ("bill", "Two invoices", "I was charged twice in May.\n- \nJohn Doe",
     "billing", "high", 0.75, "charge", True, 0, "", "John Doe"),
    ("bill2", "Question", "Please look at my refund\nRegards\nKim Lee",
     "billing", "medium", 0.75, "refund", True, 0, "", "Kim Lee"),
    ("wish", "Idea", "It would be nice to sort by colour.\n\nSincerely, me\nLisa",
     "feature_request", "low", 0.7, "would be nice", False, 0, "", "Lisa"),
    ("polite", "Plan question", "Which plan has exports?\nThank you\nProject Manager",
     "feedback", "low", 0.65, "thank", True, 0, "", "Project Manager"),
    ("ask", "Hours", "When do you open on weekdays in the summer months?",
     "product_inquiry", "medium", 0.6, None, False, 0, "", "Mary Ann"),
    ("toxic", "Bad", "Your stupid tool is useless garbage. I hate it.\nfoo bar baz qux\nx@y.z",
     "product_inquiry", "medium", 0.6, None, False, 4, "", "Mary Ann"),
    ("pii", "Data", "Call 555-123-4567, card 4111 1111 1111 1111, id 123-45-6789 and my e-mail is a@b.c okay",
     "product_inquiry", "medium", 0.6, None, False, 0, "PHONE_NUMBER,CREDIT_CARD,US_SSN", "Mary Ann"),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(
        [(g[0], "mary_ann@x.org", g[1], g[2]) for g in GOLDEN], "id string, sender string, subject string, body string")
    out = C.classify(df)
    toxic = F.size(F.filter(F.array(*[F.lit(t) for t in TOXIC_TERMS]),
                            lambda t: F.contains(F.lower("body"), t)))
    kinds = F.regexp_replace(F.array_join(Q.messages(Q.pii_violations(F.col("body"))), ","), "PII detected: ", "")
    out = out.withColumns({
        "acct": C.needs_account(F.col("category"), F.col("body")), "toxic": toxic, "pii": kinds,
        "name": G.customer_name(F.col("sender"), F.col("body")),
    })
    return {r["id"]: r for r in out.collect()}


@pytest.mark.parametrize("case", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden(rows, case):
    r = rows[case[0]]
    got = (r["category"], r["priority"], r["confidence"], r["first_hit"], r["acct"], r["toxic"], r["pii"], r["name"])
    assert got == case[3:]


def test_gate_and_route(spark):
    df = spark.createDataFrame(
        [("billing", 0.5), ("billing", 0.49), ("unrelated", 0.9), ("feedback", 0.1), ("feature_request", 0.9)],
        "category string, confidence double")
    routes = [r[0] for r in df.select(C.route(F.col("category"), F.col("confidence"))).collect()]
    assert routes == ["process", "skip", "skip", "feedback", "feedback"]
    assert C.process_gate(df).count() == 2


def test_corpus_category(spark):
    df = spark.createDataFrame([("technical_support",), ("product_inquiry",), ("other",)], "c string")
    assert [r[0] for r in df.select(C.corpus_category(F.col("c"))).collect()] == ["technical", "general", "other"]


def test_model_verdict_needs_valid_fields(spark):
    good = '{"category":"billing","priority":"low","confidence":1.0,"reasoning":"r"}'
    cases = [good, good.replace("1.0", "1.01"), good.replace("billing", "sales"), "nope", None]
    df = spark.createDataFrame([(str(i), "s", "bug", a) for i, a in enumerate(cases)],
                               "id string, subject string, body string, answer string")
    got = [r["class_origin"] for r in C.classify_with_model(df, "answer").orderBy("id").collect()]
    assert got == ["model", "rules", "rules", "rules", "rules"]


def test_whole_word_option(spark):
    df = spark.createDataFrame([("an explanation",), ("my plan",)], "b string")
    got = df.select(C.needs_account(F.lit("x"), F.col("b")), C.needs_account(F.lit("x"), F.col("b"), whole_word=True)).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True)]


def test_escalation_of_nothing(spark):
    df = spark.createDataFrame([("We ESCALATE this",), ("",), (None,)], "r string")
    assert [r[0] for r in df.select(C.has_escalation(F.col("r"))).collect()] == [True, False, False]
