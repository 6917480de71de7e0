"""Mended cases: gaps in threads, addresses held twice, single-part mails."""

import base64

from pyspark.sql import functions as F

from deskspark.operators import accounts as A
from deskspark.operators import mail as M


def test_thread_references_over_gaps(spark):
    rows = [("t", p, f"<{m}>") for p, m in ((0, "a"), (1, "b"), (3, "c"), (7, "d"))] + [("u", 5, "<x>")]
    df = spark.createDataFrame(rows, "thread_id string, position int, raw string")
    got = {r.message_id: (r.in_reply_to, r.references) for r in M.thread_references(df, F.col("raw")).collect()}
    assert got == {"<a>": (None, "<a>"), "<b>": ("<a>", "<a> <b>"), "<c>": ("<b>", "<a> <b> <c>"),
                   "<d>": ("<c>", "<a> <b> <c> <d>"), "<x>": (None, "<x>")}


def test_an_address_held_twice_does_not_double_mails(spark):
    mails = spark.createDataFrame([(i, "a@x.example") for i in range(3)], "id int, sender string")
    accounts = spark.createDataFrame([(7, "a@x.example", "late"), (2, "a@x.example", "first")], "customer_id int, email string, name string")
    got = A.account_360(mails, accounts).collect()
    assert len(got) == 3 and {r.name for r in got} == {"first"}


def test_single_part_of_another_type_is_the_body(spark):
    def coded(text):
        return base64.urlsafe_b64encode(text.encode()).decode()

    parts = spark.createDataFrame([
        ("one", 0, "text/calendar", coded("BEGIN")), ("none", 0, "", coded("plain words")),
        ("two", 0, "text/calendar", coded("BEGIN")), ("two", 1, "image/png", coded("x")), ("empty", 0, "text/csv", ""),
    ], "message_id string, part_no int, mime_type string, data string")
    got = {r.message_id: r.body for r in M.select_body(parts).collect()}
    assert got == {"one": "BEGIN", "none": "plain words", "two": M.NO_BODY, "empty": M.NO_BODY}


def test_messages_without_a_thread(spark):
    rows = [("t", 1, "a"), ("t", 2, "b"), ("t", 2, "b"), (None, 1, "c"), (None, 2, "d"), ("c", 3, "e"), (None, 4, None), (None, None, None),
            ("u", None, "f"), ("u", 1, "g")]
    df = spark.createDataFrame(rows, "thread_id string, position int, own string")
    got = sorted(((r.thread_id, r.position, r.own, r.in_reply_to, r.references) for r in M.thread_references(df, F.col("own")).collect()), key=str)
    want = [("t", 1, "a", None, "<a>"), ("t", 2, "b", "a", "<a> <b>"), ("t", 2, "b", "a", "<a> <b>"), (None, 1, "c", None, "<c>"),
            (None, 2, "d", None, "<d>"), ("c", 3, "e", "c", "<c> <e>"), (None, 4, None, None, ""), (None, None, None, None, ""),
            ("u", None, "f", None, "<f>"), ("u", 1, "g", "f", "<f> <g>")]
    assert got == sorted(want, key=str)
