"""Lookups in keyed streaming state against plain as-of search, over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from deskspark.sources.mail import stream_parquet
from deskspark.streaming import keyed_state as K

SHAPE = "key string, us long, id string, value string"
LIFE = 100


def make(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "a", "b", None])
        at = rng.randrange(0, 3_000) * 1_000_000 + rng.choice([0, 0, 1])
        rows.append((key, at, f"q{i}", None) if rng.random() < 0.6 else (key, at, None, f"v{i}"))
    return rows


def plain(rows, known=()):
    """The newest entry not after each question and not older than LIFE, the larger value of equal times."""
    entries = [r for r in [*known, *rows] if r[2] is None and r[0] is not None and r[1] is not None]
    out = set()
    for key, at, name, _ in rows:
        if name is not None and key is not None and at is not None:
            hits = [(t, v) for k, t, _, v in entries if k == key and at - LIFE * 1_000_000 <= t <= at]
            if hits:
                out.add((name, *max(hits)))
    return out


def write(spark, rows, folder):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(folder)


def answers(spark, folder):
    out = spark.read.parquet(folder).select("id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "value")
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture()
def job(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run(rows, lateness="1 day"):
        write(spark, rows, src)
        stream = stream_parquet(spark, src, SHAPE).withColumn("ts", F.timestamp_micros("us"))
        K.drain(K.as_of(stream, LIFE, lateness), out, checkpoint)
        return answers(spark, out)

    return run


def test_lookup_and_restart(job):
    first, second = make(150, 1), make(150, 2)
    second = [(k, t, q and q + "'", v) for k, t, q, v in second]
    known = [*first, (None, None, None, None), ("a", None, "x", None), ("a", 5, None, None)]
    got = job(known)
    assert got == plain(first) and len(got) > 20
    # the restarted query holds the entries of the first run and answers new questions only
    assert job(second) == got | plain(second, first)


def test_state_ends_with_the_watermark(spark, job):
    day = 86_400 * 1_000_000
    assert job([("a", 10, None, "v1"), ("a", 20, "q1", None)], "1 second") == {("q1", 10, "v1")}
    assert len(job([("z", day, "q2", None)], "1 second")) == 1  # moves the watermark on
    assert len(job([("z", 2 * day, "q3", None)], "1 second")) == 1
    # an entry that late is dropped with its question, and an old bucket is empty
    assert len(job([("a", 30, "q4", None)], "1 second")) == 1


def test_store_setting_is_restored(spark):
    before = spark.conf.get(K.STORE, None)
    with K.rocks_state(spark):
        assert spark.conf.get(K.STORE) == K.ROCKS
    assert spark.conf.get(K.STORE, None) == before


def test_many_keys_share_a_call(job, monkeypatch):
    """Groups of the state are bounded by shards, not by keys, and keys of a shard do not mix."""
    monkeypatch.setattr(K, "SHARDS", 2)
    rows = [(k and f"{k}{i % 4}", at, q, v) for i, (k, at, q, v) in enumerate(make(400, 3))]
    got = job(rows)
    assert got == plain(rows) and len(got) > 5


def test_state_is_grouped_by_shard(spark):
    plan = K.as_of(spark.readStream.format("rate").load().selectExpr(
        "string(value) AS key", "timestamp AS ts", "string(NULL) AS id", "'v' AS value"), LIFE)._jdf.queryExecution().logical().toString()
    assert "TransformWithStateInPySpark" in plan and "shard" in plan
