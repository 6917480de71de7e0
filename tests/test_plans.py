"""Plan shapes that must hold at scale."""

import os

import pytest

import __spark_entry__ as entry
from deskspark.registry.retrieval import labelled_vectors

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_pairwise_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(entry.queries()["recent_invoices"](spark, SF))
    assert text.count("WindowGroupLimit") == 2


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(labelled_vectors(spark, SF))
    assert "PushedFilters: [In(label" in text
    text = plan(entry.queries()["status_breakdown"](spark, SF))
    assert "ReadSchema: struct<event_type:string,props:string>" in text


def test_rules_stay_in_the_jvm(spark):
    for name in ("classify_keywords", "quality_score", "pii_redact", "reply_cleanup", "compress", "md_sections"):
        assert "Python" not in plan(entry.queries()[name](spark, SF)), name


def test_markdown_is_shuffled_once(spark):
    assert plan(entry.queries()["md_sections"](spark, SF)).count("Exchange hashpartitioning") == 1
