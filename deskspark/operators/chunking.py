"""Markdown sectioning, size split, chunk metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from deskspark import rules as R
from deskspark.functions import text as X
from deskspark.functions.batches import parts
from deskspark.functions.isolation import bisected
from deskspark.settings import DEFAULTS, Settings

UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
FENCE = "```"
TILDES = "~~~"
SEPARATORS = ("\n\n", "\n", " ", "")


def _code_spans(lines: Column) -> Column:
    """(start, end) line numbers of fenced code; the closing line is not part of a span.

    Folds over the fence lines only. A fence is closed by a line of its own kind.
    """
    def mark(line: Column, i: Column) -> Column:
        single = F.regexp_count(line, F.lit(FENCE)) == 1
        kind = F.when(F.startswith(line, F.lit(FENCE)), F.lit(FENCE)).when(
            F.startswith(line, F.lit(TILDES)), F.lit(TILDES))
        return F.struct(i.alias("i"), kind.alias("kind"), (single | (kind == TILDES)).alias("opens"))

    marks = F.filter(F.transform(lines, mark), lambda m: m["kind"].isNotNull())
    none = F.struct(
        F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("kind"),
        F.array().cast("array<struct<s:int,e:int>>").alias("spans"),
    )

    def step(state: Column, m: Column) -> Column:
        closes = state["kind"] == m["kind"]
        closed = F.struct(
            F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("kind"),
            F.concat(state["spans"], F.array(F.struct(state["at"].alias("s"), m["i"].alias("e")))).alias("spans"),
        )
        opened = F.struct(m["i"].alias("at"), m["kind"].alias("kind"), state["spans"].alias("spans"))
        return F.when(state["at"].isNull() & m["opens"], opened).when(closes, closed).otherwise(state)

    def finish(state: Column) -> Column:
        tail = F.array(F.struct(state["at"].alias("s"), F.size(lines).alias("e")))
        return F.when(state["at"].isNotNull(), F.concat(state["spans"], tail)).otherwise(state["spans"])

    return F.aggregate(marks, none, step, finish)


def markdown_sections(docs: DataFrame, text: str = "text", key: str = "source") -> DataFrame:
    """Sections of each document with their header path.

    Levels 1-3 open sections and are taken out of the text; deeper headers stay. Lines are trimmed;
    lines of a paragraph are joined by a newline, paragraphs of a section by two blanks and a
    newline; neighbouring sections with the same path are one. A window covers one document.
    """
    clean = F.transform(F.split(F.col(text), "\n"), lambda ln: F.regexp_replace(X.strip(ln), UNPRINTABLE, ""))
    rest = [c for c in docs.columns if c != text]
    spans = docs.withColumn("_lines", clean).withColumn("_code", _code_spans(F.col("_lines")))
    lines = spans.select(*rest, "_code", F.posexplode("_lines").alias("_pos", "_line"))
    in_code = F.exists("_code", lambda s: (s["s"] <= F.col("_pos")) & (F.col("_pos") < s["e"]))
    lines = lines.withColumn("_in", in_code).drop("_code")
    level = F.when(~F.col("_in"), F.length(X.blank_to_null(F.regexp_extract("_line", r"^(#{1,3})(?: |$)", 1))))
    lines = lines.withColumn("_level", level)

    so_far = W.partitionBy(key).orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)

    def latest(n: int) -> Column:
        title = X.strip(F.substr(F.col("_line"), F.lit(n + 1)))
        here = F.struct(F.col("_pos").alias("pos"), title.alias("title"))
        return F.last(F.when(F.col("_level") == n, here), ignorenulls=True).over(so_far)

    breaks = F.col("_level").isNotNull() | (~F.col("_in") & (F.col("_line") == ""))
    lines = lines.withColumns({
        "_h1": latest(1), "_h2": latest(2), "_h3": latest(3),
        "_para": F.sum(breaks.cast("int")).over(so_far),
    })

    def pos(c: str) -> Column:
        return F.coalesce(F.col(f"{c}.pos"), F.lit(-1))

    lines = lines.filter(~breaks).withColumns({
        "header_1": F.col("_h1.title"),
        "header_2": F.when(pos("_h2") > pos("_h1"), F.col("_h2.title")),
        "header_3": F.when(pos("_h3") > F.greatest(pos("_h1"), pos("_h2")), F.col("_h3.title")),
    })
    path = F.struct("header_1", "header_2", "header_3")
    in_order = W.partitionBy(key).orderBy("_pos")
    lines = lines.withColumn("_path", path).withColumn("_prev", F.lag("_path").over(in_order))
    opens = F.coalesce(~F.col("_prev").eqNullSafe(F.col("_path")), F.lit(True)).cast("int")
    lines = lines.withColumn("section", F.sum(opens).over(so_far))

    grouped = lines.groupBy(*rest, "section", "header_1", "header_2", "header_3").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_para", "_line"))).alias("_body")
    )

    def glued(body: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            same = F.get(body, i - 1)["_para"] == x["_para"]
            gap = F.when(i == 0, F.lit("")).when(same, F.lit("\n")).otherwise(F.lit("  \n"))
            return F.concat(gap, x["_line"])

        return F.array_join(F.transform(body, piece), "")

    return grouped.withColumn("content", X.let(F.col("_body"), glued)).drop("_body")


def _pieces(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Split at the coarsest separator present, recurse into long pieces, pack with overlap."""
    mark = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(mark) + 1:] if mark in separators else ()
    if mark:
        head, *tail = text.split(mark)
        units = [u for u in [head, *(mark + t for t in tail)] if u]
    else:
        units = list(text)
    out, run = [], []
    for unit in units:
        if len(unit) < size:
            run.append(unit)
            continue
        out += _pack(run, size, overlap)
        run = []
        out += _pieces(unit, size, overlap, finer) if finer else [unit]
    return out + _pack(run, size, overlap)


def _pack(units: list[str], size: int, overlap: int) -> list[str]:
    """Fill chunks up to the size; each new chunk starts with the tail of the one before."""
    chunks, start, length = [], 0, 0
    for end, unit in enumerate(units):
        if length + len(unit) > size and end > start:
            chunks.append("".join(units[start:end]).strip())
            while length > overlap or (length + len(unit) > size and length > 0):
                length -= len(units[start])
                start += 1
        length += len(unit)
    chunks.append("".join(units[start:]).strip())
    return [c for c in chunks if c]


def pieces(text: str | None, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of a text of at most `size` characters; a short one stays whole, an empty one has none."""
    if not text:
        return []
    return [text] if len(text) <= size else _pieces(text, size, overlap, separators)


def size_splitter(settings: Settings = DEFAULTS):
    """Arrow-batched column function text -> array of pieces; short texts stay whole."""
    size, overlap = settings.chunk_size, settings.chunk_overlap

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t, size, overlap, SEPARATORS))

    return split


def split_or_fall_back(docs: DataFrame, splitter: Callable[[str], list[str]], column: str = "content", settings: Settings = DEFAULTS) -> DataFrame:
    """Documents cut into sections by a user's splitter, long sections by size: (..., section, piece, `column`, error_message).

    A document on which the splitter fails is cut by size as a whole, as one section, and carries the error; others are not touched by it.
    """
    rest = [c for c in docs.columns if c != column]
    docs = docs.select(*rest, column)
    shape = T.StructType([*docs.schema.fields[:-1], T.StructField("error_message", T.StringType()),
                          T.StructField("section", T.IntegerType()), T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, -1):
            texts = batch.column(-1).to_pylist()
            values, errors = bisected(lambda some: [splitter(t) for t in some], [texts])
            cut = [([] if v is None else list(v)) if e is None else [t] for v, e, t in zip(values, errors, texts)]
            yield _exploded(batch, cut, shape.names, [pa.array(errors, pa.string())])

    sections = docs.mapInArrow(run, shape).where(F.col(column) != "")
    return split_long(sections, column, settings)


def split_long(sections: DataFrame, column: str = "content", settings: Settings = DEFAULTS) -> DataFrame:
    """Explode sections into pieces. Only long texts travel to Python; short ones stay in the JVM."""
    rest = [c for c in sections.columns if c != column]
    size = F.length(column)
    short = sections.filter(size <= settings.chunk_size).select(*rest, F.lit(0).alias("piece"), column)
    long = sections.filter(size > settings.chunk_size).select(*rest, column)
    shape = T.StructType([*long.schema.fields[:-1], T.StructField("piece", T.IntegerType()), T.StructField(column, T.StringType())])
    limit, overlap = settings.chunk_size, settings.chunk_overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, -1):
            yield _exploded(batch, [pieces(t, limit, overlap, SEPARATORS) for t in batch.column(-1).to_pylist()], shape.names)

    return short.unionByName(long.mapInArrow(run, shape))


def _exploded(batch: pa.RecordBatch, lists: list[list[str]], names: list[str], more: Sequence[pa.Array] = ()) -> pa.RecordBatch:
    """A row for each string of each row's list: all columns but the last, those of `more`, its place in the list, the string."""
    sizes = [len(x) for x in lists]
    at = pa.array(np.repeat(np.arange(len(lists)), sizes))
    place = pa.array([i for n in sizes for i in range(n)], pa.int32())
    flat = pa.array([x for some in lists for x in some], batch.schema.types[-1])
    return pa.RecordBatch.from_arrays([*[c.take(at) for c in [*batch.columns[:-1], *more]], place, flat], names)


def chunk_category(content: Column, source: Column, rules: Sequence[R.ChunkRule] = R.CHUNK_RULES) -> Column:
    """Struct (category, priority): content words first, then file-name words, else general."""
    stem = F.lower(F.regexp_extract(source, r"([^/]+?)(?:\.[^./]*)?$", 1))

    def verdict(name: str, priority: str) -> Column:
        return F.struct(F.lit(name).alias("category"), F.lit(priority).alias("priority"))

    def ladder(lower: Column) -> Column:
        tests = [(X.contains_any(lower, r.content_terms), r) for r in rules]
        tests += [(X.contains_any(stem, r.file_terms), r) for r in rules]
        out = None
        for hit, r in tests:
            value = verdict(r.category, r.priority)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(verdict(*R.CHUNK_DEFAULT))

    return X.let(F.lower(content), ladder)


def doc_type(content: Column, types: Sequence[tuple[str, Sequence[str]]] = R.DOC_TYPES) -> Column:
    def ladder(lower: Column) -> Column:
        out = None
        for name, terms in types:
            hit = X.contains_any(lower, terms)
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out.otherwise(F.lit(R.DOC_TYPE_DEFAULT))

    return X.let(F.lower(content), ladder)


def enrich(chunks: DataFrame) -> DataFrame:
    verdict = chunk_category(F.col("content"), F.col("source"))
    return chunks.withColumns({"_cat": verdict, "doc_type": doc_type(F.col("content"))}).withColumns({
        "category": F.col("_cat.category"), "priority": F.col("_cat.priority"),
    }).drop("_cat")


def build_chunks(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents (source, text) to enriched chunks with stable ids."""
    pieces = split_long(markdown_sections(docs.select("source", "text")), "content", settings)
    ids = F.concat_ws("#", "source", F.col("section").cast("string"), F.col("piece").cast("string"))
    return enrich(pieces.withColumn("chunk_id", ids)).select(
        "chunk_id", "content", "source", "header_1", "header_2", "header_3", "category", "priority", "doc_type")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"))
