import base64
import json

import pytest
from pyspark.sql import functions as F

from deskspark.functions import text as X
from deskspark.operators import mail as M
from deskspark.sources import mail as S


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("John Doe <john@example.com>", "john@example.com"), ("john@example.com", "john@example.com"),
    ("list: a.b-c@d.org (x)", "a.b-c@d.org"), ("nobody", "nobody"), ("<a> <b@c.d>", "a"),
])
def test_sender(spark, raw, want):
    assert one(spark, raw, M.sender_address) == want


@pytest.mark.parametrize("raw,want", [
    (" <a@b> ", "<a@b>"), ("a@b", "<a@b>"), ("<<a@b>>", "<a@b>"), ("", ""), (None, ""),
])
def test_message_id(spark, raw, want):
    assert one(spark, raw, M.normalise_message_id) == want


def test_reference_chain(spark):
    df = spark.createDataFrame([("<a>  b <a>", "<b>", " c "), (None, None, "x"), ("", "<x>", "x")],
                               "r string, i string, m string")
    got = [r[0] for r in df.select(M.reference_chain(F.col("r"), F.col("i"), F.col("m"))).collect()]
    assert got == ["<a> <b> <c>", "<x>", "<x>"]


def test_reply_subject_and_recipient(spark):
    assert one(spark, "Hello", M.reply_subject) == "Re: Hello"
    assert one(spark, "RE: Hello", M.reply_subject) == "RE: Hello"
    assert one(spark, "A <b@c> <d>", M.recipient) == "b@c"
    assert one(spark, "b@c", M.recipient) == "b@c"


def test_body_normalise(spark):
    assert one(spark, "\n  a \t\n\n\n\n\tb  \n", M.normalise_body) == "a\n\nb"


def test_html(spark):
    page = "<html><!-- x > y --><script>var a='</p>';</script><p>A &amp;lt; B</p>\n \n\n<b>c</b>  d</html>"
    assert one(spark, page, X.html_text) == "var a='</p>';A &lt; B\n\nc d"
    kept = one(spark, "<p>x</p><script>s()</script>", X.html_text)
    dropped = one(spark, "<p>x</p><script>s()</script>", lambda c: X.html_text(c, drop_script=True))
    assert (kept, dropped) == ("xs()", "x")


def test_date(spark):
    as_of = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    got = [one(spark, v, lambda c: M.parse_mail_date(c, as_of).cast("string")) for v in (
        "Tue, 5 Mar 2024 10:00:00 +0200", "5 Mar 2024 10:00:00 +0000", "yesterday", None)]
    assert got == ["2024-03-05 08:00:00", "2024-03-05 10:00:00", "2020-01-01 00:00:00", "2020-01-01 00:00:00"]


def b64(s):
    return base64.urlsafe_b64encode(s.encode()).decode()


def test_body_selection(spark):
    parts = spark.createDataFrame([
        ("a", 0, "text/plain", b64("first")), ("a", 1, "text/html", b64("<p>h</p>")), ("a", 2, "text/plain", b64("last ?>~")),
        ("b", 0, "text/html", b64("<p>one</p>")), ("b", 1, "text/html", b64("<p>two</p>")),
        ("c", 0, "text/plain", "***"), ("c", 1, "text/html", b64("<i>x</i>")), ("d", 0, "image/png", b64("z")),
        ("e", 0, "text/plain", ""),
    ], "message_id string, part_no int, mime_type string, data string")
    got = {r[0]: r[1] for r in M.select_body(parts).collect()}
    assert got == {"a": "last ?>~", "b": "two", "c": "x", "d": "z", "e": "No body content"}


def test_scan_limits_and_seen(spark):
    rows = [(str(i), f"u{i}@x", ["INBOX", "UNREAD"] if i % 2 else ["INBOX"], ["promotions"] if i == 3 else [], f"2024-01-0{i}")
            for i in range(1, 8)]
    df = spark.createDataFrame(rows, "id string, sender string, labels array<string>, tabs array<string>, received_at string")
    seen = spark.createDataFrame([("1",)], "id string")
    assert {r.id for r in M.scan_unread(df, seen).collect()} == {"3", "5", "7"}
    assert [r.id for r in M.scan_unread(df, seen, max_results=2).collect()] == ["7", "5"]
    assert {r.id for r in M.scan_support(df, seen).collect()} == {"5", "7"}


def test_json_folder(spark, tmp_path):
    for name, row in {
        "b.json": {"id": "x1", "sender": "s", "subject": "t", "body": "b"},
        "a.json": {"sender": "s", "subject": "t", "body": "b\nc"},
        "c.json": {"sender": "s", "subject": "t"}, "d.json": {"sender": "q", "subject": "t", "body": ""},
    }.items():
        (tmp_path / name).write_text(json.dumps(row, indent=1))
    (tmp_path / "note.txt").write_text("{}")
    mails, rejects = S.read_json_mails(spark, str(tmp_path), "2024-01-01")
    assert sorted(r.id for r in mails.collect()) == ["email_001", "email_003", "x1"]
    assert [r.file for r in rejects.collect()] == ["c.json"]


def test_mailbox_export(spark):
    head = [("from", "Kim <k@x.org>"), ("Date", "5 Mar 2024 10:00:00 +0000")]
    messages = spark.createDataFrame(
        [("m", None, head, ["UNREAD"], [])],
        "id string, thread_id string, headers array<struct<name:string,value:string>>, labels array<string>, tabs array<string>")
    parts = spark.createDataFrame([("m", 0, "text/plain", b64("hi"))], "message_id string, part_no int, mime_type string, data string")
    r = S.mailbox_mails(messages, parts, "2020-01-01").first()
    assert (r.sender, r.subject, r.body, r.thread_id, str(r.received_at)) == ("k@x.org", "No Subject", "hi", "m", "2024-03-05 10:00:00")


def test_defaults(spark):
    df = spark.createDataFrame([("1", "", None, None)], "id string, subject string, sender string, thread_id string")
    r = M.with_defaults(df).first()
    assert (r.subject, r.sender, r.thread_id) == ("No Subject", "Unknown", "1")


def test_numbering_over_ranges(spark):
    df = spark.range(1000).select(F.format_string("f%05d", 1000 - F.col("id")).alias("file")).repartition(7)
    got = [(r.file, r.place) for r in S.numbered(df, "file").orderBy("file").collect()]
    assert got == [(f"f{i:05d}", i) for i in range(1, 1001)]
