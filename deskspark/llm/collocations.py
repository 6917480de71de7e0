"""Phrases that collocate, counted in suffix trees cut at a few words and partitioned by prefix.

The string that is indexed is the word sequence of all texts; a suffix is the words from one place on, cut at MOST words and at the
end of its piece. As in vertical partitioning, the prefixes of suffixes are counted first and packed by their counts into groups
that fit a memory budget. A prefix above the budget is extended by its next word, up to the whole cut suffix. The subtree of a
group is built from its suffixes alone: sorted by words, equal suffixes are a leaf with a count, and the count of a node is the
total of the leaves below it. Nodes above a group's prefix are not read there; a round before has counted them.

Suffixes are read elastically, in two rounds: trees of two words first, then of MOST words only below the pairs that occur often
enough, since a phrase is never more frequent than a pair in it. What may be left out of a round is told by bit tables
of fixed size, whose false hits only cost work: counts are compared with the threshold when a node is complete.

Words are 64-bit hashes of language and word from the second scan on. Every vocabulary is tested for two words of the same hash, and
the hash seed is changed until there are none, so counts are exact.

Scale: prefixes hash to CELLS cells, and a group is a run of cells up to the budget, so what the driver packs is bounded; the
budget is BUDGET suffixes, or N / CELLS where that is more, which bounds the lists of extended prefixes by CELLS. A task
adds up equal suffixes of CHUNK words before the shuffle, so a suffix that holds a third of all rows is a row a chunk; a group is sorted
by Spark, which spills, and its tree is read as a stream that holds one open node a depth.

Null texts count as empty, a null language is UNKNOWN (and one with the texts whose language has that name). Repeated rows count as
often as they occur, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.llm.common import LOWER, UPPER, filled
from deskspark.session import materialise

LEAST = 30
MOST = 4
TOP = 2000
COVER = 80
SCALE = 2_000_000
UNKNOWN = "und"

CELLS = 1 << 14
BUDGET = 1 << 20
CHUNK = 1 << 20
#: Bits of the table of frequent words or pairs: 4 MB.
BITS = 1 << 25
#: Rows a ranking task takes at a time, in multiples of the rows wanted.
FAN = 16
SEEDS = 8

_BREAK = b"\xff"  # never a byte of UTF-8
_TABLE = bytearray(range(256))
for _a, _b in zip(UPPER, LOWER):
    _TABLE[ord(_a)] = ord(_b)
for _a in ".,;:!?\n\x0b\x0c\r":
    _TABLE[ord(_a)] = _BREAK[0]
_TABLE[ord("\t")] = ord(" ")
_TABLE = bytes(_TABLE)


def pieces(text: str) -> list[bytes]:
    """The words of a text in UTF-8, with _BREAK between pieces."""
    return text.encode().translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ").split()


class Codes(dict):
    """Hash of each word of a language, as a signed long and never zero; breaks are zero. Holds `most` words at a time."""

    def __init__(self, lang: str, seed: int):
        self.head, self.seed = f"{len(lang)}:{lang}".encode(), seed

    def __missing__(self, word: bytes) -> int:
        code = 0
        if word != _BREAK:
            code = xxhash.xxh64_intdigest(self.head + word, self.seed) or 1
            code -= (code >> 63) << 64
        self[word] = code
        return code


def count_words(docs: DataFrame, seed: int, most: int = 1 << 18) -> DataFrame:
    """(lang, code, word, n) of (lang, text); a task holds `most` distinct words at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Codes, dict[bytes, int]]] = {}
        size = 0

        def flush():
            for lang, (codes, counts) in held.items():
                counts.pop(_BREAK, None)
                words = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array([codes[w] for w in words], pa.int64()),
                     pa.array([w.decode() for w in words], pa.string()), pa.array(list(counts.values()), pa.int64())],
                    ["lang", "code", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                if lang not in held:
                    held[lang] = Codes(lang, seed), {}
                counts = held[lang][1]
                before = len(counts)
                for w in pieces(text.as_py()):
                    counts[w] = counts.get(w, 0) + 1
                size += len(counts) - before + 1
                if size > most:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, code long, word string, n long") \
        .groupBy("lang", "code", "word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """count_words by a seed for which no two words share a code, written; and the seed."""
    for seed in range(SEEDS):
        words = materialise(count_words(docs, seed), f"words{seed}")
        if words.groupBy("code").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


def _slot(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return ((a.view(np.uint64) >> np.uint64(23)) ^ np.asarray(b).astype(np.int64).view(np.uint64)) & np.uint64(BITS - 1)


def _slot_column(a: Column, b: Column) -> Column:
    return F.shiftrightunsigned(a, 23).bitwiseXOR(b).bitwiseAND(F.lit(BITS - 1).cast("long"))


def bit_table(keys: DataFrame, a: Column, b: Column) -> np.ndarray:
    """The slots of keys as BITS bits, 4 MB at most whatever the input."""
    slot = _slot_column(a, b)
    rows = keys.select(F.bitmap_bucket_number(slot + 1).alias("k"), F.bitmap_bit_position(slot + 1).alias("p")) \
        .groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.collect():
        part = np.frombuffer(r.bits, np.uint8)
        out[(r.k - 1) * len(part):r.k * len(part)] = part  # numbers and buckets count from one
    return out


def _hits(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def encode(docs: DataFrame, table: np.ndarray, seed: int, most: int = 1 << 18) -> DataFrame:
    """(codes) of (lang, text): the words that may be frequent, zero for anything between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Codes] = {}
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                out = []
                for lang, text in zip(batch.column(0), batch.column(1)):
                    if sum(map(len, held.values())) > most:
                        held = {}
                    lang = lang.as_py()
                    codes = held.setdefault(lang, Codes(lang, seed))
                    words = pieces(text.as_py())
                    line = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
                    line[~_hits(table, _slot(line, 0))] = 0
                    before = np.zeros_like(line)
                    before[1:] = line[:-1]
                    out.append(line[(line != 0) | (before != 0)])
                ends = np.cumsum([0, *map(len, out)])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))], ["codes"])

    return docs.mapInArrow(run, "codes array<long>")


class Groups:
    """Which group a prefix belongs to: runs of cells up to a budget, prefixes above it extended by the next word."""

    def __init__(self, totals: np.ndarray, budget: int, hot: np.ndarray, hot_pairs: np.ndarray):
        self.hot, self.hot_pairs = hot, hot_pairs
        self.of_cell, group, held = np.zeros(CELLS, np.int32), 0, 0
        for cell, n in enumerate(totals.tolist()):
            if held and held + n > budget:
                group, held = group + 1, 0
            held += n
            self.of_cell[cell] = group
        self.count = group + 1

    def of(self, *codes: np.ndarray) -> np.ndarray:
        key = codes[0].copy()
        if len(self.hot):
            more = np.isin(key, self.hot)
            key = np.where(more, _mixed(codes[0], codes[1]), key)
            if len(self.hot_pairs):
                more &= np.isin(key, self.hot_pairs)
                key = np.where(more, _mixed(key, codes[2]), key)
        return self.of_cell[(key.view(np.uint64) & np.uint64(len(self.of_cell) - 1)).astype(np.int64)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a prefix and its next word; prefixes that share one are only dealt alike."""
    return ((a.view(np.uint64) << np.uint64(1)) ^ (b.view(np.uint64) >> np.uint64(7))).view(np.int64)


def _mixed_column(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 1).bitwiseXOR(F.shiftrightunsigned(b, 7))


def partition_prefixes(prefixes: DataFrame, words: int) -> Groups:
    """Groups of the prefixes of suffixes that start with one of (c1, n), or (c1, c2, n) for words = 2."""
    first = prefixes.groupBy("c1").agg(F.sum("n").cast("long").alias("n"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    budget = max(BUDGET, -(-total // CELLS))
    cells = np.zeros(CELLS)
    cell = F.col("key").bitwiseAND(F.lit(CELLS - 1).cast("long"))

    def add(rows: DataFrame) -> None:
        for r in rows.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).collect():
            cells[r.cell] += r.n

    add(first.where(F.col("n") <= budget).select(F.col("c1").alias("key"), "n"))
    hot = first.where(F.col("n") > budget).collect()  # fewer than CELLS: their n add up to the total at most
    pairs = []
    if words > 1 and hot:
        of_hot = prefixes.join(F.broadcast(first.where(F.col("n") > budget).select("c1")), "c1") \
            .groupBy(_mixed_column(F.col("c1"), F.col("c2")).alias("key")).agg(F.sum("n").alias("n"))
        add(of_hot.where(F.col("n") <= budget))
        pairs = of_hot.where(F.col("n") > budget).collect()
    # what is below an extended prefix is dealt over all cells by its next word
    cells += sum(r.n for r in (pairs if words > 1 else hot)) / CELLS
    return Groups(cells, budget, np.array([r.c1 for r in hot], np.int64), np.array([r.key for r in pairs], np.int64))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """The codes of many rows, about `most`, in a line: a zero after each and three more at the end."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(0)
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for i in range(batch.num_rows):
            held += [flat[ends[i]:ends[i + 1]], np.zeros(1, np.int64)]
            size += ends[i + 1] - ends[i] + 1
            if size >= most:
                yield np.concatenate([*held, np.zeros(MOST - 1, np.int64)])
                held, size = [], 0
    if held:
        yield np.concatenate([*held, np.zeros(MOST - 1, np.int64)])


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows start that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def suffixes(coded: DataFrame, groups: Groups, depth: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(part, c1 .. c`depth`, n): cut suffixes of two words or more, equal ones of a chunk added up.

    With `pairs`, the bit table of pairs, suffixes of three words or more whose pairs are all in it.
    """
    names, chunk = [f"c{i + 1}" for i in range(depth)], CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _chunks(batches, chunk):
            both = (line[:-1] != 0) & (line[1:] != 0)
            if pairs is not None:
                both[both] = _hits(pairs, _slot(line[:-1][both], line[1:][both]))
                # a pair may start a suffix of three words if the next place starts a pair, too
                at = np.flatnonzero(both[:-1] & both[1:])
            else:
                at = np.flatnonzero(both)
            cols = [line[at], line[at + 1]]
            for k in range(2, depth):
                open_ = both[at + k - 1] & (cols[-1] != 0)
                cols.append(np.where(open_, line[at + k], 0))
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            start = _runs(cols)
            n = np.diff(np.append(start, len(order)))
            cols = [c[start] for c in cols]
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups.of(*cols), pa.int32()), *map(pa.array, cols), pa.array(n, pa.int64())], ["part", *names, "n"])

    return coded.mapInArrow(run, "part int, " + ", ".join(f"{c} long" for c in names) + ", n long")


def subtrees(rows: DataFrame, groups: Groups, depth: int, least_depth: int, least: int) -> DataFrame:
    """(words, c1 .. c`depth`, n): nodes of `least_depth` words or more with `least` occurrences, zeros below a node's words.

    One stream of sorted suffixes a partition; a node is complete when the next suffix leaves it.
    """
    names = [f"c{i + 1}" for i in range(depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list[int], int]] = {}

        def node(k: int, keys: list[np.ndarray], n: np.ndarray):
            ok = (n >= least) & (keys[-1] != 0)
            blank = np.zeros(int(ok.sum()), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(blank), k, np.int32)), *[pa.array(keys[i][ok] if i < k else blank) for i in range(depth)],
                 pa.array(n[ok])], ["words", *names, "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(depth)]
            n = batch.column(depth).to_numpy()
            for k in range(least_depth, depth + 1):
                keys, leaves = cols[:k], n
                if k in open_:
                    keys = [np.append(v, c) for v, c in zip(open_[k][0], keys)]
                    leaves = np.append(open_[k][1], n)
                start = _runs(keys)
                totals, keys = np.add.reduceat(leaves, start), [c[start] for c in keys]
                yield node(k, [c[:-1] for c in keys], totals[:-1])
                open_[k] = [c[-1] for c in keys], totals[-1]
        for k, (keys, total) in open_.items():
            yield node(k, [np.array([c], np.int64) for c in keys], np.array([total], np.int64))

    dealt = rows.repartitionById(groups.count, F.col("part")).sortWithinPartitions(*names)
    return dealt.select(*names, "n").mapInArrow(run, "words int, " + ", ".join(f"{c} long" for c in names) + ", n long")


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(words, c1 .. c4, f) of all phrases of up to MOST words with `least` occurrences, and (lang, code, word, n) of all words."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), filled(F.col(text)).alias("text"))
    words, seed = vocabulary(docs)
    often = words.where(F.col("n") >= least).select(F.col("code").alias("c1"), "n")
    coded = materialise(encode(docs, bit_table(often, F.col("c1"), F.lit(0).cast("long")), seed), "coded")
    groups = partition_prefixes(often, 1)
    pairs = materialise(subtrees(suffixes(coded, groups, 2), groups, 2, 2, least), "pairs")
    groups = partition_prefixes(pairs.select("c1", "c2", "n"), 2)
    in_pair = bit_table(pairs, F.col("c1"), F.col("c2"))
    longer = subtrees(suffixes(coded, groups, MOST, in_pair), groups, MOST, 3, least)
    none = F.lit(0).cast("long")
    blank = [none.alias(f"c{i}") for i in range(1, MOST + 1)]
    counts = often.select(F.lit(1).alias("words"), "c1", *blank[1:], F.col("n").alias("f")) \
        .unionByName(pairs.select("words", "c1", "c2", *blank[2:], F.col("n").alias("f"))) \
        .unionByName(longer.withColumnRenamed("n", "f"))
    return materialise(counts, "phrase_counts"), words


def _key(codes: list[Column]) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(*[(codes[i] if i < len(codes) else zero).alias(f"c{i + 1}") for i in range(MOST)])


def uncovered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """The phrases (key, words, f) no longer phrase stands for: none that holds its words has `cover` percent of its count."""
    c = [F.col(f"key.c{i + 1}") for i in range(MOST)]
    inner = [F.when(F.col("words") >= max(i + k, k + 1), _key(c[i:i + k])) for k in range(2, MOST) for i in range(MOST - k + 1)]
    inside = phrases.where("words > 2").select("words", "key", "f", F.explode(F.array(*inner)).alias("part")).where("part is not null")
    most = inside.groupBy(F.col("part").alias("key")).agg(F.max("f").alias("longest"))
    return phrases.join(most, "key", "left").where(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("f") * cover)).drop("longest")


def _parts(phrases: DataFrame) -> DataFrame:
    """(key, words, f, slot, part): the two sides of each cut of a phrase and its single words."""
    c = [F.col(f"key.c{i + 1}") for i in range(MOST)]
    rows = []
    for size in range(2, MOST + 1):
        spans = {(0, k) for k in range(1, size)} | {(k, size) for k in range(1, size)} | {(k, k + 1) for k in range(size)}
        rows += [F.when(F.col("words") == size, F.struct(F.lit(a * 10 + b).alias("slot"), _key(c[a:b]).alias("part")))
                 for a, b in sorted(spans)]
    return phrases.select("key", "words", "f", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("p")) \
        .select("key", "words", "f", "p.slot", "p.part")


def scored(candidates: DataFrame, counts: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of candidates (key, words, f), by the counts of all phrases and words.

    A part of f occurrences is in f / LEAST phrases at most, so parts above 1/4096 of the largest sum, a bounded number, are broadcast.
    """
    known = counts.select(_key([F.col(f"c{i + 1}") for i in range(MOST)]).alias("part"), F.col("f").alias("n"), "words")
    named = words.select(F.col("code"), "lang", "word")
    single = known.where("words = 1").join(named, F.col("part.c1") == F.col("code")).select("part", "n", "lang", "word")
    none = F.lit(None).cast("string")
    known = materialise(
        single.unionByName(known.where("words > 1").select("part", "n", none.alias("lang"), none.alias("word"))), "known_parts")
    share = known.where("word is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] / 4096
    hot = materialise(known.where(F.col("n") > share), "hot_parts")
    first = _parts(candidates).join(F.broadcast(hot), "part", "left")
    rest = first.where("n is null").drop("n", "lang", "word").join(known.where(F.col("n") <= share), "part")
    met = first.where("n is not null").unionByName(rest.select(*first.columns))

    def at(a: int, b: int, what: str) -> Column:
        return F.max(F.when(F.col("slot") == a * 10 + b, F.col(what)))

    sides = sorted({(0, k) for k in range(1, MOST)} | {(k, size) for size in range(2, MOST + 1) for k in range(1, size)})
    one = met.groupBy("key", "words", "f").agg(
        F.max("lang").alias("lang"), *[at(a, b, "n").alias(f"n{a}{b}") for a, b in sides],
        *[at(k, k + 1, "word").alias(f"w{k}") for k in range(MOST)])
    cuts = []
    for size in range(2, MOST + 1):
        for k in range(1, size):
            both = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(f as decimal(19,0))) div (n0{k} + n{k}{size})")
            cuts.append(F.when(F.col("words") == size, F.struct(
                both.alias("score"), F.lit(k).alias("k"), F.col(f"n0{k}").alias("l"), F.col(f"n{k}{size}").alias("r"))))
    low = F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull()))
    return one.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(MOST)]).alias("phrase"), F.col("f").alias("a"), low.alias("cut")) \
        .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """The `top` rows of each lang with their rank; a task ranks about FAN * top rows of a lang at a time."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = materialise(rows, "scored")
    deal = -(-rows.count() // (FAN * top))
    while deal > 1:
        window = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(deal))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top).drop("rank")
        deal = -(-deal // FAN)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= top)


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two words or more that stand out most, `top` a language."""
    counts, words = phrase_counts(docs, lang, text, least)
    found = counts.where("words > 1").select(_key([F.col(f"c{i + 1}") for i in range(MOST)]).alias("key"), "words", "f")
    best = first_of_each(scored(materialise(uncovered(found, cover), "uncovered"), counts, words), top)
    n = words.groupBy("lang").agg(F.sum("n").cast("long").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
