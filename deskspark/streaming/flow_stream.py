"""The mail job on a stream: every micro-batch of mails goes through the whole flow and is committed as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from deskspark.plans import mail_flow as P
from deskspark.streaming import ledger as L


def flow_batch(accounts: DataFrame, kb: P.Knowledge, as_of: str, **options) -> Callable[[DataFrame, L.Write], None]:
    """Work of one batch: the mails as they came, a result row each, and from these metrics and cache rows.

    `options` are those of `mail_flow`. Mails are stored first, so the flow's branches read a table instead of
    asking the source again. Repeated ids are left to `mail_stream.dedup_stream` ahead of this.
    """
    def work(batch: DataFrame, write: L.Write) -> None:
        mails = write("mails", batch)
        results = write("results", P.mail_flow(mails, accounts, kb, as_of, **options))
        write("metrics", P.metrics(results))
        write("cache", P.cache_writes(results, mails))

    return work
