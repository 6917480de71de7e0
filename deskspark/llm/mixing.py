"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Its documents are expected target / size times: the whole part is
given out as certain copies, the fraction is the inclusion probability of one more copy. Documents are
ranked by random odds over inclusion odds (Pareto order sampling) and taken in that order until the words
of the source come nearest to the target, which fixes the sample's size in words.

The rank is never sorted as a whole: ranks are squashed into the unit interval and counted in GRID cells a
source, the cell in which the target falls is split into GRID cells again, and only documents of that cell
(about one in GRID * GRID) are put in exact order. So a source may hold any share of all rows.

The random number of a document is taken from the md5 of its id: reruns agree, and documents with the same
id get the same number and are ordered by size. Null ids count as the text "null"; null and empty texts have size 0 and are
taken as whole copies only. A source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.llm.common import WORD
from deskspark.session import materialise

GRID = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(id_col: Column) -> Column:
    """Random number in (0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights are dealt to the sources in code point order, null last. A source whose share would be over
    `limit` times its size gets that, and what is over is shared again by weight. Sorted by limit over weight
    the full sources are a prefix, so one pass of running sums finds where sharing ends.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % n + 1).cast("int"))
    ranked = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", weight) \
        .withColumn("most", F.col("source_size") * F.lit(float(limit)))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("at"))
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = ranked.withColumn("level", (
        F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    ) / F.sum("weight").over(onward))
    ends = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    # the first source that isn't full sets the level; without one, all are full
    levelled = levelled.withColumn("level", F.first(ends, ignorenulls=True).over(by.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("weight") * F.col("level")))
    return levelled.select("source", "source_size", target.alias("target"))


def _cell(c: Column) -> Column:
    return F.floor(c * GRID).cast("int")


def _cut(cells: DataFrame) -> DataFrame:
    """Per source the cell in which the running words pass `rest`, and the words before it; none: all cells fit."""
    w = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("run", F.sum("words").over(w))
    return run.where("run > rest").groupBy("key").agg(F.min_by(F.struct(
        "cell", (F.col("run") - F.col("words")).alias("before")), "cell").alias("cut"))


def _placed(docs: DataFrame) -> DataFrame:
    """Add z, the odds ratio squashed into [0, 1), and its cells. Null for documents that are never drawn."""
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    z = F.when(F.col("p") > 0, F.least(odds / (1 + odds), F.lit(1.0 - 2.0 ** -52)))
    return docs.withColumn("z", z).withColumn("c1", _cell(F.col("z"))) \
        .withColumn("c2", _cell(F.col("z") * GRID - F.col("c1")))


def pareto_cuts(docs: DataFrame) -> DataFrame:
    """Where each key's sample ends, from (key, id, size, u, p, rest); a key without a row is taken whole.

    p is the inclusion probability in [0, 1], u the random number, rest the words wanted from the key's
    documents (the same in all its rows). Taken is the prefix in order of odds(u) / odds(p) whose words are
    nearest to rest; the shorter one in a tie. Documents with p = 0 are never taken.
    """
    ranked = _placed(docs).where("z is not null")
    first = _cut(ranked.groupBy("key", F.col("c1").alias("cell")).agg(
        F.sum("size").alias("words"), F.first("rest").alias("rest")))
    first = materialise(first.withColumnRenamed("cut", "cut1"), "cut1")
    inside = ranked.join(first, "key").where(F.col("c1") == F.col("cut1.cell"))
    second = _cut(inside.groupBy("key", F.col("c2").alias("cell")).agg(
        F.sum("size").alias("words"), F.first(F.col("rest") - F.col("cut1.before")).alias("rest")))
    second = materialise(second.withColumnRenamed("cut", "cut2"), "cut2")
    last = inside.join(second, "key").where(F.col("c2") == F.col("cut2.cell"))
    order = Window.partitionBy("key").orderBy("z", "size", "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("run", F.sum("size").over(order) + F.col("cut1.before") + F.col("cut2.before"))
    # the document that passes the target is taken if that comes nearer
    fits = (F.col("run") <= F.col("rest")) | (
        F.col("run") - F.col("rest") < F.col("rest") - (F.col("run") - F.col("size")))
    border = last.where(fits).groupBy("key").agg(F.max(F.struct("z", "size", "id")).alias("border"))
    return first.join(second, "key", "left").join(border, "key", "left")


def drawn(docs: DataFrame) -> Column:
    """1 if a row with the columns of `_placed` and of the cuts is in the sample, else 0."""
    place = F.struct("z", "size", "id")
    taken = F.when(F.col("z").isNull(), F.lit(False)).when(F.col("cut1").isNull(), F.lit(True)) \
        .when(F.col("c1") != F.col("cut1.cell"), F.col("c1") < F.col("cut1.cell")) \
        .when(F.col("c2") != F.col("cut2.cell"), F.col("c2") < F.col("cut2.cell")) \
        .otherwise(F.coalesce(place <= F.col("border"), F.lit(False)))
    return taken.cast("int")


def _key(source: Column) -> Column:
    """A null source has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _rated(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id, size) with target, whole copies, inclusion probability and random number."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.join(wanted, "key").withColumn("rate", rate).withColumn("whole", F.floor("rate")) \
        .withColumn("p", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("rate") - F.col("whole"))) \
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")) \
        .withColumn("u", unit(F.col("id")))


def _mix(docs: DataFrame, id_col: str, text: str, source: str, weights, share, limit) -> DataFrame:
    """(id, size, source_size, target, copies, doc): doc holds the row as it came."""
    def sized(df: DataFrame, *more: Column) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), _key(F.col(source)).alias("key"), size_of(F.col(text)).alias("size"), *more)

    narrow = materialise(sized(docs, F.col(source).cast("string").alias("source")), "sizes")
    wanted = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    wanted = materialise(wanted.select(_key(F.col("source")).alias("key"), "source_size", "target"), "targets")
    cuts = materialise(pareto_cuts(_rated(narrow.drop("source"), wanted)), "cuts")
    rows = sized(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    placed = _placed(_rated(rows, wanted)).join(cuts, "key", "left")
    copies = (F.col("whole") + drawn(placed)).cast("long")
    return placed.select("id", "size", "source_size", "target", copies.alias("copies"), "doc")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(id_col, size, source_size, target, copies, taken), one row per document.

    Targets are `share` of all words by `weights`, `limit` times a source's words at most. A document gets
    at most ceil(limit) copies.
    """
    narrow = docs.select(id_col, text, source)
    return _mix(narrow, id_col, text, source, weights, share, limit).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The mix itself: documents with the columns they came with, each as often as it is taken."""
    out = _mix(docs, id_col, text, source, weights, share, limit).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
