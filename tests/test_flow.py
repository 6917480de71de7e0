import pytest
from pyspark.sql import functions as F

from deskspark.operators import accounts as A
from deskspark.operators import cache as I
from deskspark.operators import index as IX
from deskspark.operators import reports as J
from deskspark.plans import mail_flow as P

AS_OF = "2024-01-10 00:00:00"


@pytest.fixture(scope="module")
def setup(spark):
    mails = spark.createDataFrame([
        ("1", "kim@x", "Invoice", "My invoice is wrong.\nKim", "2024-01-09"),
        ("2", "bob@x", "Login", "The login page shows an error code 42.\nBob", "2024-01-09"),
        ("3", "eve@x", "Nice", "I love it. Really.\nEve", "2024-01-09"),
        ("4", "zed@x", "Invoice", "Where is the invoice of May?\nZed", "2024-01-09"),
    ], "id string, sender string, subject string, body string, t string").withColumn("received_at", F.col("t").cast("timestamp_ntz")).drop("t")
    customers = spark.createDataFrame([("c1", "kim@x", "Kim", "active", "2020-01-01")], "customer_id string, email string, name string, status string, created_at string")
    subs = spark.createDataFrame([("s", "c1", "Pro", 9.0, "monthly", 1, "2024-02-01")],
                                 "subscription_id string, customer_id string, plan_name string, plan_price double, billing_cycle string, is_active int, next_billing_date string")
    pays = spark.createDataFrame([], "payment_id string, customer_id string, payment_method string, last_payment_date string, last_payment_amount double")
    usage = spark.createDataFrame([("u", "c1", '{"seats": 1}', "{}")], "usage_id string, customer_id string, current_usage string, plan_limits string")
    accounts = A.typed_accounts(A.active_accounts(customers, subs, pays, usage))
    docs = spark.createDataFrame([(1, "An error code 42 on the login page means a stale session."), (2, "Invoices are sent monthly to the owner of the plan."),
                                  (3, "Nothing else matters here.")], "doc_id long, text string")
    return mails, accounts, P.Knowledge(docs, IX.stored_index(docs))


def test_flow(setup):
    got = {r.id: r for r in P.mail_flow(*setup, AS_OF).collect()}
    assert {i: (r.route, r.context_from, r.status) for i, r in got.items()} == {
        "1": ("process", "database", "completed_approved"), "2": ("process", "documents", "completed_approved"),
        "3": ("feedback", "none", "completed_approved"), "4": ("process", "documents", "completed_approved")}
    assert "Plan: Pro at $9.00/monthly" in got["1"].final_response
    assert "stale session" in got["2"].final_response and got["2"].docs_retrieved == 1
    assert got["3"].feedback_line.startswith("Eve | 2024-01-09 00:00:00 | I love it. Really.")
    assert (got["3"].email_sent, got["3"].action, got["3"].qa_score) == (False, "mark_read", 10.0)
    assert got["2"].email_sent and got["2"].used_cache is False


def test_supplied_replies(spark, setup):
    replies = spark.createDataFrame([
        ("1", "Dear Kim,\nwe will escalate this to a specialist.\nBest regards,\nX"), ("2", "stupid [TODO]"),
        ("4", "Dear Zed,\n" + "we understand and call 555-123-4567. " * 3 + "Hope you have a great day!"),
    ], "id string, reply string")
    got = {r.id: r for r in P.mail_flow(*setup, AS_OF, replies=replies).collect()}
    assert (got["1"].status, got["1"].action, got["1"].email_sent) == ("completed_approved", "add_label", True)
    assert (got["2"].status, got["2"].action, got["2"].email_sent) == ("requires_manual_review", "add_label", False)
    assert "[PHONE REDACTED]" in got["4"].final_response and got["4"].status == "requires_manual_review"


def test_cache_reuse(spark, setup):
    mails, *_ = setup
    first = P.mail_flow(*setup, AS_OF)
    cache = P.cache_writes(first, mails)
    assert {r.response for r in cache.collect()} == {r.final_response for r in first.filter("route = 'process'").collect()}
    stored = I.upsert(cache.limit(0), cache).withColumn("response", F.concat(F.lit("cached "), "response"))
    again = {r.id: r for r in P.mail_flow(*setup, AS_OF, cache=stored).collect()}
    assert [again[i].used_cache for i in "1234"] == [True, True, False, True]
    assert again["1"].final_response.startswith("cached Dear")


def test_metrics_and_reports(setup):
    results = P.mail_flow(*setup, AS_OF)
    s = J.run_summary(P.metrics(results)).first()
    assert s.total_mails == 4 and s.approval_rate == 1.0
    assert J.run_summary(P.metrics(results).limit(0)).count() == 0
    t = J.outcome_tally(results).first()
    assert (t.total, t.sent, t.feedback_saved, t.manual_review) == (4, 3, 1, 0)


def test_revision_pick(spark):
    df = spark.createDataFrame([("a", 0, "x", False), ("a", 1, "y", True), ("a", 2, "z", True), ("b", 0, "p", False), ("b", 2, "q", False),
                                ("b", 3, "late", True)], "id string, attempt int, draft string, approved boolean")
    got = {r.id: (r.draft, r.status) for r in J.pick_revision(df).collect()}
    assert got == {"a": ("y", "completed_approved"), "b": ("q", "requires_manual_review")}


def test_actions(spark):
    df = spark.createDataFrame([("completed_skipped", "", False), ("error", "x", False), ("requires_manual_review", "x", False),
                                ("completed_approved", "x", False), ("completed_approved", "our specialist", False),
                                ("completed_approved", "", False), ("completed_approved", "x", True)],
                               "status string, final_response string, feedback_saved boolean")
    got = [(r.action, r.email_sent) for r in J.decide_action(df).collect()]
    assert got == [("mark_read", False), ("none", False), ("add_label", False), ("mark_read", True), ("add_label", True), ("none", False), ("mark_read", False)]
