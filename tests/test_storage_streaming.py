import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from deskspark import schemas
from deskspark.operators import cache as I
from deskspark.operators import reply as G
from deskspark.session import materialise, shared_dir
from deskspark.sinks import tables
from deskspark.sources import corpus, mail
from deskspark.streaming import mail_stream as S


def test_markdown_source_and_stored_index(spark, tmp_path):
    docs = tmp_path / "docs" / "deep"
    docs.mkdir(parents=True)
    (docs / "billing.md").write_text("# Pay\nhow to pay an invoice\n")
    (docs.parent / "a.md").write_text("## Start\nzebra\n")
    (docs / "skip.txt").write_text("x")
    read = lambda: corpus.read_markdown(spark, str(tmp_path / "docs"))
    assert read().count() == 2
    with pytest.raises(FileNotFoundError):
        empty = tmp_path / "empty"
        empty.mkdir()
        corpus.read_markdown(spark, str(empty))
    path = str(tmp_path / "chunks")
    chunks = corpus.load_or_build_chunks(spark, path, read)
    assert {r.category for r in chunks.collect()} == {"billing", "general"}
    (docs / "more.md").write_text("# New\noauth\n")
    assert corpus.load_or_build_chunks(spark, path, read).count() == 2          # stored one is reused
    chunks = corpus.load_or_build_chunks(spark, path, read, force=True)
    assert chunks.count() == 3
    index = str(tmp_path / "index")
    ix = corpus.load_or_build_index(spark, index, chunks)
    assert ix.corpus.first().n == 3 and ix.postings.filter("term = 'oauth'").count() == 1
    assert corpus.load_or_build_index(spark, index, chunks.limit(0)).corpus.first().n == 3
    assert corpus.drop_index(spark, path, index) == [True, True]
    assert corpus.drop_index(spark, path) == [False]


def test_customer_tables(spark, tmp_path):
    for name, ddl in schemas.CUSTOMER_TABLES.items():
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / name))
    got = corpus.read_tables(spark, str(tmp_path))
    assert got["usage"].columns == schemas.names(schemas.USAGE)


def test_insert_if_absent(spark):
    a = spark.createDataFrame([(1, "old")], "k int, v string")
    b = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert sorted(map(tuple, tables.insert_if_absent(a, b, ["k"]).collect())) == [(1, "old"), (2, "new")]


def test_feedback_log(spark, tmp_path):
    m = spark.createDataFrame([("1", "feedback", "kim@x", "Nice. Good.\n"), ("2", "feature_request", "a@b", "Add it.")],
                              "id string, category string, sender string, body string")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    for _ in range(2):
        tables.append_feedback(G.feedback_lines(m, at), str(tmp_path / "log"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "log" / "category=feedback" / "*.txt")))
    assert text == "Nice. Good. | 2024-01-02 03:04:05 | Nice. Good.\n" * 2


def test_shared_folder(spark):
    a, b = shared_dir(spark), shared_dir(spark)
    assert a != b and os.path.dirname(a) == os.path.dirname(b)
    df = materialise(spark.range(3), "x")
    assert df.count() == 3 and "parquet" in df._jdf.queryExecution().toString().lower()


def write_events(spark, folder, n=40, files=4):
    df = spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(id))").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    df.repartition(files).write.parquet(folder)
    return spark.read.parquet(folder)


def test_drain_equals_batch(spark, tmp_path):
    batch = write_events(spark, str(tmp_path / "in"))
    stream = mail.stream_parquet(spark, str(tmp_path / "in"), schemas.EVENTS, files_per_poll=1)
    for _ in range(2):                                  # a second drain finds nothing new
        S.drain(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in batch.select("event_id").collect())
    assert len(glob.glob(str(tmp_path / "cp" / "commits" / "[0-9]*"))) >= 4      # rate cap: one file per batch
    S.drain_table(S.running_counts(stream, "event_type"), str(tmp_path / "c"), str(tmp_path / "cp2"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {
        tuple(r) for r in batch.groupBy("event_type").count().collect()}


def test_stream_dedup(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"))
    stream = mail.stream_parquet(spark, str(tmp_path / "in"), schemas.EVENTS, files_per_poll=1)
    S.drain(S.dedup_stream(stream, "user_id", "ts", "10 days").select("user_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))


def test_poll_and_cache_log(spark, tmp_path):
    folder = tmp_path / "mails"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps({"id": f"m{i}", "sender": "s", "subject": f"s{i}", "body": "b"}))
    (folder / "bad.json").write_text(json.dumps({"id": "x"}))
    log = str(tmp_path / "log")
    stream = mail.stream_json_mails(spark, str(folder))

    def handle(batch, batch_id):
        rows = I.cache_rows(batch.select(
            F.lit("c").alias("category"), "subject", "body", F.col("id").alias("response"), F.lit(9.0).alias("qa_score"),
            F.lit("2024-01-05").cast("timestamp_ntz").alias("ts")))
        S.cache_log_writer(log)(rows, batch_id)
        S.cache_log_writer(log)(rows, batch_id)          # a repeated batch replaces itself

    query = S.poll(stream, handle, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert S.read_cache_log(spark, log, "2024-01-06").count() == 3
    assert spark.read.parquet(log).count() == 3
    assert S.read_cache_log(spark, log, "2024-01-20").count() == 0
