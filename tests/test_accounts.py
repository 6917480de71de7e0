import pytest
from pyspark.sql import functions as F

from deskspark.operators import accounts as A


@pytest.fixture(scope="module")
def tables(spark):
    customers = spark.createDataFrame(
        [("c1", "a@x", "Ann", "active", "2020-01-01T00:00:00"), ("c2", "b@x", "Bob", "suspended", "2020-01-01T00:00:00"),
         ("c3", "c@x", "Cy", "active", "2020-01-01T00:00:00"), ("c4", "d@x", "Di", "active", "2020-01-01T00:00:00"),
         ("c5", "A@x", "Ann2", "active", "2020-01-01T00:00:00")],
        "customer_id string, email string, name string, status string, created_at string")
    subs = spark.createDataFrame(
        [("s1", "c1", "Old", 5.0, "monthly", 1, "2024-01-01T00:00:00"), ("s2", "c1", "New", 9.0, "yearly", 1, "2024-02-01T00:00:00"),
         ("s3", "c2", "Gone", 5.0, "monthly", 0, "2024-01-01T00:00:00"), ("s4", "c4", "Pro", 7.5, "monthly", 1, "2024-01-01T00:00:00"),
         ("s5", "zz", "Lost", 1.0, "monthly", 1, "2024-01-01T00:00:00"), ("s6", "c5", "Pro", 7.5, "monthly", 1, "bad date")],
        "subscription_id string, customer_id string, plan_name string, plan_price double, billing_cycle string, is_active int, next_billing_date string")
    pays = spark.createDataFrame([("p1", "c1", "visa", "2024-01-05T00:00:00", 0.0)],
                                 "payment_id string, customer_id string, payment_method string, last_payment_date string, last_payment_amount double")
    usage = spark.createDataFrame([("u1", "c1", '{"seats": 3, "api": 2.5}', '{"seats": 10}'), ("u5", "c5", "{}", "{}")],
                                  "usage_id string, customer_id string, current_usage string, plan_limits string")
    return customers, subs, pays, usage


def test_joins(tables):
    got = {r.customer_id: r for r in A.active_accounts(*tables).collect()}
    assert set(got) == {"c1", "c4", "c5"}           # no, inactive and orphan subscriptions are out
    assert got["c1"].plan_name == "New" and got["c4"].payment_method is None


def test_sender_match_is_case_sensitive(spark, tables):
    mails = spark.createDataFrame([("1", "a@x"), ("2", "A@X")], "id string, sender string")
    assert [r.id for r in A.account_360(mails, A.active_accounts(*tables)).collect()] == ["1"]


def test_strict_typing(tables):
    acc = A.active_accounts(*tables)
    strict = {r.customer_id: r for r in A.typed_accounts(acc).collect()}
    assert set(strict) == {"c1"}                    # c4 has no usage row, c5 a bad date
    assert strict["c1"].last_payment_amount is None
    assert A.typed_accounts(acc, strict=False).count() == 3


def test_summary(tables):
    row = A.typed_accounts(A.active_accounts(*tables)).select(
        A.account_summary(F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))).first()[0]
    lines = row.split("\n")
    assert lines[0] == "Status: ACTIVE" and lines[5] == "Next billing: 2024-02-01 (0 days)"
    assert lines[7] == "Last payment: $0.00 on 2024-01-05" and lines[8] == "Usage: api: 2.5/unlimited; seats: 3/10"


def test_days_floor(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 02:00:00",)], "t string")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    assert [r[0] for r in df.select(A.days_between(F.col("t").cast("timestamp_ntz"), now)).collect()] == [-1, 1]


def test_invoices(spark):
    df = spark.createDataFrame([("c", f"i{n}", f"2024-01-{n:02d}") for n in range(1, 9)] + [("d", "x", "2024-01-01")],
                               "customer_id string, invoice_id string, created_at string")
    got = A.recent_invoices(df).collect()
    assert sorted(r.invoice_id for r in got if r.customer_id == "c") == ["i4", "i5", "i6", "i7", "i8"]
    assert len(got) == 6


def test_audits(spark, tables):
    customers, subs, *_ = tables
    assert [r.subscription_id for r in A.orphans(subs, customers.withColumnRenamed("customer_id", "k"), "customer_id", "k").collect()] == ["s5"]
    assert [tuple(r) for r in A.duplicate_keys(subs, "customer_id").collect()] == [("c1", 2)]
    df = spark.createDataFrame([(None, 1), ("a", None), (None, None)], "x string, y int")
    assert {r.column_name: r.nulls for r in A.missing_values(df, ["x", "y"]).collect()} == {"x": 2, "y": 2}


def test_snapshot_reuse(spark):
    ts = lambda s: f"2024-01-01 00:{s}"
    snaps = spark.createDataFrame([("a", ts("00:00"), "s1"), ("a", ts("04:00"), "s2"), ("b", ts("00:00"), "s3")],
                                  "email string, t string, snapshot_id string").withColumn("cached_at", F.col("t").cast("timestamp_ntz")).drop("t")
    mails = spark.createDataFrame([("1", "a", ts("03:00")), ("2", "a", ts("04:00")), ("3", "a", ts("09:00")), ("4", "a", ts("09:01")),
                                   ("5", "b", ts("05:00")), ("6", "c", ts("00:00")), ("7", "a", "2023-12-31 23:59:59")],
                                  "id string, email string, t string").withColumn("received_at", F.col("t").cast("timestamp_ntz")).drop("t")
    got = {r.id: r.snapshot_id for r in A.fresh_snapshots(mails, snaps).collect()}
    assert got == {"1": "s1", "2": "s2", "3": "s2", "5": "s3"}
