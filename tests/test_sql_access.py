"""SQL surface and counted writes."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from deskspark import sql_access
from deskspark.operators import cache as I
from deskspark.operators.chunking import pieces
from deskspark.sinks import counted

ACCOUNTS = "customer_id string, email string, name string, plan_name string, plan_price double, next_billing_date timestamp_ntz"


@pytest.fixture()
def published(spark):
    rows = [("c1", "a@x.com", "A", "basic", 4.0, None), ("c2", "o'b@x.com", "B", "pro", 9.0, None)]
    accounts = spark.createDataFrame(rows, ACCOUNTS).withColumn("next_billing_date", F.lit("2024-01-03 01:00:00").cast("timestamp_ntz"))
    mails = spark.createDataFrame([(1, "a@x.com"), (2, "o'b@x.com"), (3, "nobody"), (4, None)], "id int, sender string")
    sql_access.publish(spark, accounts=accounts, mails=mails)
    return spark


def test_lookup_with_parameters(published):
    ask = sql_access.ask
    rows = ask(published, "SELECT customer_id FROM account_of(:address)", address="o'b@x.com").collect()
    assert [r.customer_id for r in rows] == ["c2"]
    assert ask(published, "SELECT * FROM account_of(:address)", address="' OR 1 = 1 --").count() == 0
    met = ask(published, "SELECT m.id, a.plan_name, score_band(a.plan_price) AS band, days_until(a.next_billing_date, cast(:now AS timestamp_ntz)) AS days "
                         "FROM mails m, LATERAL account_of(m.sender) a WHERE a.plan_price >= :least ORDER BY id", now="2024-01-01 02:00:00", least=1)
    assert [tuple(r) for r in met.collect()] == [(1, "basic", "low", 1), (2, "pro", "high", 1)]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "CartesianProduct" not in plan
    with pytest.raises(AnalysisException):
        ask(published, "SELECT :missing")


def test_split_text(published):
    texts = [(1, "one two\nthree four five"), (2, ""), (3, None), (4, "x" * 25), (5, "short")]
    published.createDataFrame(texts, "k int, body string").createOrReplaceTempView("texts")
    got = sql_access.ask(published, "SELECT * FROM split_text(TABLE(texts) PARTITION BY (k), 'body', 10, 2)")
    assert got.columns == ["k", "piece", "body"]
    want = [(k, i, p) for k, t in texts for i, p in enumerate(pieces(t, 10, 2))]
    assert sorted(map(tuple, got.collect())) == want and all(len(p) <= 10 for _, _, p in want)
    for call in ("'nothing', 10, 2", "'body', 10, 10"):
        with pytest.raises(AnalysisException):
            sql_access.ask(published, f"SELECT * FROM split_text(TABLE(texts) PARTITION BY (k), {call})").collect()


def test_purge_counts_in_one_pass(spark, tmp_path):
    rows = [(f"k{i}", "2024-01-01" if i % 3 else None) for i in range(30)] + [("old", "2023-01-01")]
    cache = spark.createDataFrame(rows, "cache_key string, day string").withColumn("ts", F.col("day").cast("timestamp_ntz"))
    now = F.lit("2024-01-05").cast("timestamp_ntz")
    got = counted.purge(cache, now, str(tmp_path / "live"))
    live = spark.read.parquet(str(tmp_path / "live"))
    assert (got["before"], got["after"], got["removed"]) == (31, 20, 11) == (cache.count(), live.count(), 11)
    assert str(got["oldest"]) == "2023-01-01 00:00:00" and live.columns == cache.columns
    assert I.unexpired(cache, now).exceptAll(live).isEmpty()
    none = counted.purge(cache.limit(0), now, str(tmp_path / "none"))
    assert (none["before"], none["after"], none["removed"]) == (0, 0, 0)
