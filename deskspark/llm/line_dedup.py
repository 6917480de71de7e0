"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A text is cut at line feeds. A line is its words (runs without white space), lower-cased; lines without a
word are kept as they are and never compared. A line is dropped if an earlier line, by (id, row, line number), has
the same words, or words within an edit distance of one: one word changed, added or left out. That bound
holds for lines of MIN_WORDS words or more, so two such lines are at least 0.8 alike; shorter lines are only
dropped as exact copies. Whether the earlier line is itself dropped makes no difference.

1. Equal lines become one row with their first place, by a map-side combined minimum.
   Only hashes and half keys are carried so far, no words.
2. Lines that cannot have a partner are set aside: one edit leaves the first or the second half of a line
   untouched, so a line is only of interest if another line shares that half with it (pigeonhole). That is a count
   over four hashed keys a line, which also tells where the edit must be: in the half that is not shared.
3. For what is left the variants with one word deleted in that half are emitted as hashed keys. Lines of equal length
   that meet without their i-th word differ in that word; a line that meets a variant of a longer one is that line
   with a word left out. Each key is an aggregate of first places, never a list, so a key shared by a third of all
   lines is one row per task, and no pairs are made within it.
4. Each line's earliest partner is looked up once more and the edit distance is verified on the words.

Every row is a document of its own; ids only say which is earlier. Rows are told apart by the file they are in and
their place there, which every scan sees alike; only an input that does not come straight from files is written once
with row numbers. Null ids come last, and rows with the same id or none are in the order of those places. Null and
empty texts have one line without a word. Columns of the input named like a result are replaced by it. Keys and row
places are 64-bit hashes, lines 128-bit hashes. Deletions of a line of n words that may lack a word cost n * n / 2
words of hashing, substitutions n.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.functions.text import let
from deskspark.llm.common import filled, slot_table, with_hit
from deskspark.session import materialise

MIN_WORDS = 5
#: White space other than blanks.
BLANKS = ("\t", "\x0b", "\f", "\r")
#: What a line emits: the line itself, and variants by the half it shares, with a word left open or left out.
OPEN_FIRST, OPEN_LAST, ITSELF, LESS_FIRST, LESS_LAST = 1, 2, 4, 8, 16


def normal(line: Column) -> Column:
    """The words of a line, lower-cased, with one blank between them."""
    for c in BLANKS:
        line = F.replace(line, F.lit(c), F.lit(" "))
    single = let(line, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x))
    return F.lower(F.trim(single))


def count_words(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def _hash(t: Column) -> Column:
    """128 bits of a line in two numbers: the same hash from two seeds."""
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, id, text, row): whole rows as a struct, and a row place that every scan sees alike."""
    def with_place(file: Column, at: Column) -> DataFrame:
        return docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.col(text).alias("text"),
                           F.struct(file.alias("file"), at.alias("at")).alias("row"))

    try:
        return with_place(F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index"))
    except AnalysisException:  # not a plain scan of files
        return materialise(with_place(F.lit(0).cast("long"), F.monotonically_increasing_id()), "numbered_documents")


def cut_lines(rows: DataFrame) -> DataFrame:
    """(id, row, line, part): every line as it is, numbered from 0."""
    return rows.select("id", "row", F.posexplode(F.split(filled(F.col("text")), "\n")).alias("line", "part"))


def lines_of(rows: DataFrame) -> DataFrame:
    """(place, words): every line of numbered rows with a word, normalised; place is (null id, id, row, line)."""
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "line")
    # asked of the words themselves, the filter would be pushed below them and normalise every line twice
    worded = cut_lines(rows).where(F.ltrim("part", F.lit(" " + "".join(BLANKS))) != "")
    return worded.select(place.alias("place"), normal(F.col("part")).alias("words"))


def _first(t: Column, n: Column) -> Column:
    return F.call_function("substring_index", t, F.lit(" "), n)


def _halves(t: Column) -> Column:
    """Keys of the halves that a line shares with one of its length, one word shorter or one word longer."""
    def keys(shorter: Column) -> list[Column]:
        # the shorter line has `shorter` words, of which the first h and the last shorter - h are its halves
        h = F.floor(shorter / 2).cast("int")
        return [F.xxhash64(F.lit("first"), shorter, _first(t, h)), F.xxhash64(F.lit("last"), shorter, _first(t, h - shorter))]

    return let(count_words(t), lambda n: F.array(*keys(n), *keys(n - 1)))


def _without(t: Column, n: Column, i: Column) -> Column:
    """A line of n > 1 words without its i-th."""
    return F.when(i == 1, _first(t, 1 - n)).when(i == n, _first(t, n - 1)) \
        .otherwise(F.concat(_first(t, i - 1), F.lit(" "), _first(t, i - n)))


def _variants(t: Column, use: Column) -> Column:
    """(key, role) by the flags of `_uses`: 0 the line itself, 1 a word left out, 2 a word left open at its place."""
    role = lambda key, r: F.struct(key.alias("key"), F.lit(r).alias("role"))
    on = lambda flag: use.bitwiseAND(F.lit(flag)) != 0
    none = F.array().cast("array<struct<key:bigint,role:int>>")

    def open_at(n: Column) -> Column:
        # exclusive or of all words' hashes with their places: one word is taken out in one step
        marks = F.transform(F.split(t, " "), lambda w, i: F.xxhash64(i, w))
        h = F.floor(n / 2).cast("int")
        start = F.when(on(OPEN_LAST), F.lit(1)).otherwise(h + 1)
        count = F.when(on(OPEN_FIRST), n).otherwise(h) - start + 1
        return let(marks, lambda m: let(
            F.aggregate(m, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)),
            lambda all_of: F.slice(F.transform(
                m, lambda x, i: role(F.xxhash64(F.lit("open"), n, i, all_of.bitwiseXOR(x)), 2)), start, count)))

    def left_out(n: Column) -> Column:
        h = F.floor((n - 1) / 2).cast("int")
        start = F.when(on(LESS_LAST), F.lit(1)).otherwise(h + 1)
        stop = F.when(on(LESS_FIRST), n).otherwise(h + 1)
        return F.when(on(LESS_FIRST | LESS_LAST), F.transform(
            F.sequence(start, stop), lambda i: role(F.xxhash64(F.lit("less"), _without(t, n, i)), 1))).otherwise(none)

    itself = F.when(on(ITSELF), F.array(role(F.xxhash64(F.lit("less"), t), 0))).otherwise(none)
    return let(count_words(t), lambda n: F.concat(
        itself, F.when(on(OPEN_FIRST | OPEN_LAST), open_at(n)).otherwise(none), left_out(n)))


def within_one(x: Column, y: Column) -> Column:
    """Is the edit distance of two word sequences one at most?"""
    def longer(a: Column, b: Column) -> Column:
        # b is a without the word at which they first differ
        at = F.array_position(F.zip_with(a, b, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
        return let(at, lambda i: F.concat(F.slice(a, F.lit(1), i - 1), F.slice(a, i + 1, F.size(a))) == b)

    differ = F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d))
    return F.when(F.size(x) == F.size(y), differ <= 1).when(F.size(x) == F.size(y) + 1, longer(x, y)) \
        .when(F.size(y) == F.size(x) + 1, longer(y, x)).otherwise(F.lit(False))


def _uses(distinct: DataFrame) -> DataFrame:
    """(hash, first, use): lines that share a half with a possible partner, with flags of what to emit for them."""
    halves = distinct.select("hash", "first", F.posexplode("halves").alias("k", "half"))
    longer = F.col("k") >= 2
    met = halves.groupBy("half").agg(F.count_if(~longer).alias("n0"), F.count_if(longer).alias("n1")) \
        .where("n0 > 1 or (n0 > 0 and n1 > 0)").select("half", F.expr("n0 > 1").alias("open"), F.expr("n0 > 0 and n1 > 0").alias("less"))
    met = materialise(met, "line_halves")
    # the bit table keeps most halves out of the shuffle, the join the rest
    tested = with_hit(halves, slot_table(met, F.col("half")), "hit", F.col("half")).where("hit").join(met, "half")
    first = F.col("k") % 2 == 0
    use = F.when(longer, F.when(F.col("less"), F.when(first, LESS_FIRST).otherwise(LESS_LAST)).otherwise(0)).otherwise(
        F.when(F.col("open"), F.when(first, OPEN_FIRST).otherwise(OPEN_LAST)).otherwise(0)
        + F.when(F.col("less"), ITSELF).otherwise(0))
    return tested.select("hash", "first", use.alias("use")).groupBy("hash", "first").agg(F.bit_or("use").alias("use")).where("use > 0")


def near_lines(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(hash, earlier): lines that have a partner within one edit which comes first, with that partner's place."""
    wanted = materialise(_uses(distinct), "line_candidates")
    # words are read once more at the first places only
    key = [F.col("first.row"), F.col("first.line")]
    tested = with_hit(cut_lines(rows), slot_table(wanted, *key), "hit", F.col("row"), F.col("line")).where("hit")
    picked = tested.select("row", "line", normal(F.col("part")).alias("words")).join(
        wanted.select("*", key[0].alias("row"), key[1].alias("line")), ["row", "line"]).drop("row", "line")
    picked = materialise(picked, "line_words")
    emitted = picked.select("hash", "first", F.explode(_variants(F.col("words"), F.col("use"))).alias("v")) \
        .select("hash", "first", "v.key", "v.role")
    emitted = materialise(emitted, "line_variants")
    # roles 0 and 1 meet each other, role 2 meets itself
    first_of = [F.min(F.when(F.col("role") == r, F.col("first"))).alias(f"f{r}") for r in (0, 1, 2)]
    number = [F.count_if(F.col("role") == r).alias(f"n{r}") for r in (0, 1, 2)]
    met = emitted.groupBy("key").agg(*number).where("n2 > 1 or (n0 > 0 and n1 > 0)").select("key")
    met = slot_table(materialise(met, "line_meetings"), F.col("key"))
    meeting = with_hit(emitted, met, "hit", F.col("key")).where("hit").drop("hit")
    keys = materialise(meeting.groupBy("key").agg(*first_of), "line_keys")
    other = F.when(F.col("role") == 0, F.col("f1")).when(F.col("role") == 1, F.col("f0")).otherwise(F.col("f2"))
    found = meeting.join(keys, "key").select("hash", "first", other.alias("earlier")).where("earlier < first") \
        .groupBy("hash").agg(F.min("earlier").alias("earlier"))
    words = picked.select("hash", "words", "first")
    partner = words.select(F.col("first").alias("earlier"), F.col("words").alias("partner"))
    checked = found.join(words, "hash").join(partner, "earlier") \
        .where(within_one(F.split("words", " "), F.split("partner", " ")))
    return checked.select("hash", "earlier")


def dropped_lines(rows: DataFrame) -> DataFrame:
    """(row, lines): per numbered row the sorted numbers of its lines that are dropped."""
    lines = lines_of(rows).withColumn("hash", _hash(F.col("words")))
    none = F.array().cast("array<bigint>")
    halves = F.when(count_words(F.col("words")) >= MIN_WORDS, _halves(F.col("words"))).otherwise(none)
    places = materialise(lines.select("place", "hash", halves.alias("halves")), "line_places")
    distinct = materialise(places.groupBy("hash").agg(
        F.min("place").alias("first"), F.first("halves").alias("halves"), F.count("*").alias("n")), "distinct_lines")
    near = near_lines(rows, distinct).select("hash", F.lit(True).alias("near"))
    # what happens to a line's first place decides about all: later ones are copies
    doubtful = distinct.select("hash", "first", "n").join(near, "hash", "left").where("near or n > 1") \
        .select("hash", "first", F.coalesce("near", F.lit(False)).alias("near"))
    doubtful = materialise(doubtful, "doubtful_lines")
    gone = places.select("place", "hash").join(doubtful, "hash").where(F.col("near") | (F.col("place") != F.col("first")))
    return gone.groupBy(F.col("place.row").alias("row")).agg(F.array_sort(F.collect_set("place.line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add n_lines, n_dropped and kept_text (the other lines joined by line feeds; all dropped: empty)."""
    rows = numbered(docs, id_col, text)
    gone = materialise(dropped_lines(rows), "dropped_lines")
    flagged = with_hit(rows, slot_table(gone, F.col("row")), "hit", F.col("row"))
    cut = F.split(filled(F.col("text")), "\n")
    carried = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]

    def result(df: DataFrame, dropped: Column, kept: Column) -> DataFrame:
        return df.select(*carried, F.size(cut).cast("long").alias("n_lines"),
                         dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"))

    untouched = result(flagged.where("not hit"), F.lit(0), filled(F.col("text")))
    # the lists grow with the documents, so they are never broadcast, however few there are
    met = flagged.where("hit").join(gone.hint("merge"), "row", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<int>")))
    kept = F.filter(cut, lambda _, i: ~F.array_contains("lines", i))
    return untouched.unionByName(result(met, F.size("lines"), F.array_join(kept, "\n")))
