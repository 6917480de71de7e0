"""Headline queries at one scale factor; prints one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (cores). Each query runs once to warm the JVM's
code caches on the smallest tables when present, then is timed writing to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "classify_keywords", "category_counts", "html_text", "thread_refs", "account_360", "recent_invoices",
    "snapshot_ttl", "pii_redact", "toxic_terms", "quality_score", "reply_cleanup", "content_key",
    "cache_exact", "cache_fuzzy", "dedup_content", "md_sections", "build_chunks", "bm25_stats", "knn",
    "bm25", "hybrid_search", "rrf", "compress", "retrieve_standard", "dual_retrieve", "run_summary",
    "action_decision", "mail_flow", "stream_drain", "stream_status", "sql_accounts", "purge_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    from deskspark import registry
    from deskspark.session import local_session

    registry.load_all()
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times: dict[str, float] = {}
    for name in HEADLINE:
        fn = registry.QUERIES[name]
        if os.path.isdir(warm):
            fn(spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    mails = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "mails_per_sec_full_flow": round(mails / times["mail_flow"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
