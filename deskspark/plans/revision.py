"""Bounded revision of replies, a set at a time.

Each round reviews the drafts that are still open. Rows that pass leave and are not looked at again; the others get
their findings as a note and a new draft, until none is open or the allowed number of revisions is used up.
Rounds are written tables: a lost executor costs a re-read of the round before, and no draft is made twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.operators import quality as Q
from deskspark.session import materialise
from deskspark.settings import DEFAULTS, Settings

#: Open rows (with their review and `note`) and the number of the revision; adds `revised`, null where there is none.
Redraft = Callable[[DataFrame, int], DataFrame]


def revise(rows: DataFrame, redraft: Redraft, reply: str = "reply", settings: Settings = DEFAULTS) -> DataFrame:
    """The rows with their last draft, its review, and `revision_count`. A row without a new draft stays as reviewed;
    a null draft is an empty one."""
    ended = []
    rows = rows.withColumn(reply, F.coalesce(reply, F.lit("")))
    open_rows = rows
    for number in range(settings.max_revisions + 1):
        reviewed = Q.review(open_rows, reply, settings=settings).withColumn("revision_count", F.lit(number))
        reviewed = materialise(reviewed, f"review_{number}")
        again = Q.needs_revision(F.coalesce("approved", F.lit(False)), F.coalesce("quality_score", F.lit(0.0)), settings)
        if number == settings.max_revisions:
            ended.append(reviewed)
            break
        ended.append(reviewed.where(~again))
        asked = reviewed.where(again).withColumn("note", Q.revision_note(F.col("issues"), F.col("suggestions")))
        answered = materialise(redraft(asked, number + 1), f"revision_{number + 1}")
        ended.append(answered.where("revised is null").select(*reviewed.columns))
        open_rows = answered.where("revised is not null").withColumn(reply, F.col("revised")).select(*rows.columns)
        if open_rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended)


def from_table(attempts: DataFrame) -> Redraft:
    """New drafts out of a table (id, attempt, reply) of model texts."""
    def redraft(rows: DataFrame, number: int) -> DataFrame:
        texts = attempts.where(F.col("attempt") == number).select("id", F.col("reply").alias("revised"))
        return rows.join(texts, "id", "left")

    return redraft
