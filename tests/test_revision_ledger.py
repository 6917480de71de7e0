import pytest
from pyspark.sql import functions as F

from deskspark.plans import mail_flow as P
from deskspark.plans import revision as RV
from deskspark.settings import Settings
from deskspark.streaming import flow_stream as MS
from deskspark.streaming import ledger as L
from test_flow import AS_OF, setup  # noqa: F401

GOOD = "Dear Kim,\nthank you for writing, we understand. Here is what to do next, step by step.\nHope you have a great day!"
SHAPE = "id string, reply string"


def spy(redraft, seen):
    def watched(rows, number):
        seen.append({r.id: r.note for r in rows.collect()})
        return redraft(rows, number)
    return watched


def test_revision_stops_at_the_first_approved_draft(spark):
    rows = spark.createDataFrame([("1", GOOD), ("2", "bad"), ("3", "bad"), ("4", "bad"), ("5", None)], SHAPE)
    attempts = spark.createDataFrame([
        ("1", 1, "never asked"), ("2", 1, GOOD), ("2", 2, "never asked"), ("3", 1, "still bad"), ("3", 2, GOOD),
        ("4", 1, "still bad"), ("4", 2, "bad to the end"), ("4", 3, GOOD)], "id string, attempt int, reply string")
    seen = []
    got = {r.id: r for r in RV.revise(rows, spy(RV.from_table(attempts), seen)).collect()}
    assert {i: (r.revision_count, r.reply, r.approved) for i, r in got.items() if i != "5"} == {
        "1": (0, GOOD, True), "2": (1, GOOD, True), "3": (2, GOOD, True), "4": (2, "bad to the end", False)}
    assert (got["5"].revision_count, got["5"].reply) == (0, "")  # no new draft: stays as reviewed
    assert [set(s) for s in seen] == [{"2", "3", "4", "5"}, {"3", "4"}]  # approved rows are not looked at again
    assert "1. " in seen[0]["2"]


def test_revision_limits(spark):
    rows = spark.createDataFrame([("1", "bad")], SHAPE)
    attempts = spark.createDataFrame([("1", 1, GOOD)], "id string, attempt int, reply string")
    none = RV.revise(rows, RV.from_table(attempts), settings=Settings(max_revisions=0)).collect()
    assert [(r.revision_count, r.approved) for r in none] == [(0, False)]
    assert RV.revise(rows.limit(0), RV.from_table(attempts)).count() == 0


def test_flow_with_revisions(spark, setup):  # noqa: F811
    mails, *_ = setup
    bad = spark.createDataFrame([("1", "stupid [TODO]"), ("2", "stupid"), ("3", "stupid")], SHAPE)
    attempts = spark.createDataFrame([("1", 1, GOOD), ("3", 1, "never asked")], "id string, attempt int, reply string")
    results = P.mail_flow(*setup, AS_OF, replies=bad, redraft=RV.from_table(attempts))
    got = {r.id: (r.revision_count, r.status) for r in results.collect()}
    assert got == {"1": (1, "completed_approved"), "2": (0, "requires_manual_review"),
                   "3": (0, "completed_approved"), "4": (0, "completed_approved")}
    assert [r.revision_count for r in P.metrics(results).orderBy("email_id").collect()] == [1, 0, 0, 0]
    assert P.cache_writes(results, mails).count() == 1  # a revised reply is not stored


def test_a_batch_counts_once(spark, tmp_path):
    root, calls = str(tmp_path), []

    def work(batch, write):
        calls.append(1)
        a = write("a", batch)
        if len(calls) == 1:
            raise RuntimeError("lost half way")
        write("b", a.select((F.col("id") * 2).alias("twice")))

    handle = L.once_per_batch(root, work)
    batch = spark.range(5)
    with pytest.raises(RuntimeError):
        handle(batch, 0)
    assert L.committed(spark, root, "a").count() == 0  # written, but not finished
    handle(batch, 0)
    handle(batch, 0)  # handed over again: nothing happens
    handle(spark.range(5, 7), 1)
    assert len(calls) == 3
    assert sorted((r.batch, r.id) for r in L.committed(spark, root, "a").collect()) == [(0, i) for i in range(5)] + [(1, 5), (1, 6)]
    assert sorted(r.twice for r in L.committed(spark, root, "b").collect()) == [0, 2, 4, 6, 8, 10, 12]


def test_stream_of_mails_equals_the_batch(spark, setup, tmp_path):  # noqa: F811
    mails, accounts, kb = setup
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    mails.repartition(2, "id").write.parquet(source)
    stream = spark.readStream.schema(mails.schema).option("maxFilesPerTrigger", 1).parquet(source)
    handle = L.once_per_batch(root, MS.flow_batch(accounts, kb, AS_OF))
    L.drain(stream, handle, str(tmp_path / "checkpoint"))
    want = P.mail_flow(*setup, AS_OF)
    got = L.committed(spark, root, "results")
    assert got.select("batch").distinct().count() == 2
    order = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert order(got) == order(want)
    # the query starts again without its checkpoint: both batches are handed over again and leave no second copy
    L.drain(stream, handle, str(tmp_path / "lost checkpoint"))
    assert L.committed(spark, root, "results").count() == want.count()
    assert L.committed(spark, root, "cache").count() == P.cache_writes(want, mails).count()
