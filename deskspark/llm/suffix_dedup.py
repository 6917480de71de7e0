"""Removal of repeated byte strings with suffix arrays kept in a logarithmic family of levels.

A text is its UTF-8 bytes. Every byte covered by a string of SIZE bytes that also starts anywhere else, in
the same text or in another, is removed; overlaps count, strings are judged on the input. The result is exact.

Sharding. Each window of SIZE bytes has an anchor: its leftmost ANCHOR-byte string of smallest hash, by
the upper half of the hash. Equal windows have equal anchors at the same offset, so all windows with one anchor can be judged together, apart
from all others. The windows of an anchor occurrence are neighbours; the bytes they cover are its segment.

1. A scan counts anchors and their different segments, by hash. An anchor with one occurrence has no repeated
   window; one whose segments are all equal has only repeated ones (where there are two). Neither moves a byte.
2. Only for anchors with two or more different segments, one copy of each segment goes to the anchor's shard,
   however often it occurs. A shard takes SHARD segments on average, of many anchors; windows whose hash is the only one of
   its kind under their anchor cannot repeat and are left out. An anchor's segments come in batches. A batch gets a suffix array (the starts of
   its windows in order of the SIZE bytes that follow), is merge-scanned against every existing level for equal
   windows, and becomes a level; levels of equal size merge, so there are logarithmically many.
3. A last scan takes each text's segments again, looks up the verdicts of those in question, and cuts.

Anchors with more than HOT different segments are cut finer: windows that begin within BLOCK bytes of each
other, counted from the anchor, have a core of SIZE - BLOCK + 1 bytes in common, so they are gathered by (anchor,
block, core). What still has more than CROWD members (a passage in ever new surroundings) is not gathered: the
hashes of its windows are counted by Spark, which is exact as well (128 bits) and has no limit in size.

Null and empty texts have no bytes. Rows are told apart by their position in the scan's result, so null and
repeated ids are rows like others. Texts shorter than SIZE have no windows and stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.common import slot_table, with_hit
from deskspark.session import materialise

SIZE = 200
ANCHOR = 64
#: Different segments of one anchor up to which they are gathered in a shard.
HOT = 512
#: Window starts in one block of a hot anchor, and members of a core up to which they are gathered.
BLOCK = 16
CROWD = 1 << 15
#: Windows in one batch of a shard.
BATCH = 1 << 16

#: Pieces in one shard of anchors or of cores.
SHARD = 256

_MULT = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 32) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    inverse = pow(_MULT, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _MULT, np.uint64))), dtype=np.uint64)
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, inverse, np.uint64))), dtype=np.uint64)
    return up, down


_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def string_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from every start, by prefix sums of a polynomial."""
    n = len(text)
    if n < size:
        return np.zeros(0, np.uint64)
    if len(_POWERS[0]) < n + 1:
        _POWERS[:] = _powers(max(2 * n, 1 << 16))
    up, down = _POWERS
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
        h = (sums[size:] - sums[:-size]) * down[:n - size + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours: block-wise running minima from both sides."""
    n = len(a) - width + 1
    blocks = -(-len(a) // width)
    padded = np.full(blocks * width, np.iinfo(a.dtype).max, a.dtype)
    padded[:len(a)] = a
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(text: np.ndarray, size: int = SIZE, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of every anchor occurrence of a text."""
    # the upper half of the hash decides, then the place, so the minimum tells where it is
    if len(text) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = string_hashes(text, anchor)
    width = size - anchor + 1
    low = _sliding_min(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), width)
    at = (low & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]], first, np.concatenate((first[1:], [len(at)])) - 1


def segments(data: bytes, wanted: "Slots | None" = None) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, segment hash, segment start, segment end) of each anchor occurrence of a text, or of the wanted ones."""
    h, first, last = anchors(np.frombuffer(data, np.uint8))
    if wanted is not None:
        some = wanted.have(h)
        h, first, last = h[some], first[some], last[some]
    hashed = xxhash.xxh3_64_intdigest
    for key, a, b in zip(h.view(np.int64).tolist(), first.tolist(), (last + SIZE).tolist()):
        s = hashed(data[a:b])
        yield key, s - (1 << 64) if s >> 63 else s, a, b


class SuffixArray:
    """Starts of all windows of a batch's segments, in the order of the bytes that follow."""

    def __init__(self, text: bytes, starts: list[int], owner: list[int], window: list[int]):
        keys = [text[a:a + SIZE] for a in starts]
        order = sorted(range(len(starts)), key=keys.__getitem__)
        self.text = text
        self.starts = [starts[i] for i in order]
        self.owner = [owner[i] for i in order]
        self.window = [window[i] for i in order]

    def __len__(self) -> int:
        return len(self.starts)

    def key(self, i: int) -> bytes:
        return self.text[self.starts[i]:self.starts[i] + SIZE]

    def repeats(self, hit: set[tuple[int, int]]) -> None:
        """Mark windows that are equal to a neighbour in the order."""
        before = None
        for i in range(len(self)):
            now = self.key(i)
            if now == before:
                hit.add((self.owner[i - 1], self.window[i - 1]))
                hit.add((self.owner[i], self.window[i]))
            before = now

    def scan(self, other: "SuffixArray", hit: set[tuple[int, int]]) -> None:
        """Merge-scan of two arrays: mark windows that occur in both."""
        i = j = 0
        n, m = len(self), len(other)
        while i < n and j < m:
            x, y = self.key(i), other.key(j)
            if x < y:
                i += 1
            elif y < x:
                j += 1
            else:
                a, b = i, j
                while i < n and self.key(i) == x:
                    i += 1
                while j < m and other.key(j) == x:
                    j += 1
                hit.update(zip(self.owner[a:i], self.window[a:i]))
                hit.update(zip(other.owner[b:j], other.window[b:j]))

    def merged(self, other: "SuffixArray") -> "SuffixArray":
        out = object.__new__(SuffixArray)
        shift = len(self.text)
        out.text = self.text + other.text
        both = [(self.key(i), 0, i) for i in range(len(self))] + [(other.key(j), 1, j) for j in range(len(other))]
        both.sort()  # two sorted runs: a linear merge
        sides = (self, other)
        out.starts = [sides[s].starts[i] + (shift if s else 0) for _, s, i in both]
        out.owner = [sides[s].owner[i] for _, s, i in both]
        out.window = [sides[s].window[i] for _, s, i in both]
        return out


class Family:
    """Suffix arrays in levels; a new one is scanned against all, then equal-sized levels merge."""

    def __init__(self):
        self.levels: dict[int, SuffixArray] = {}
        self.hit: set[tuple[int, int]] = set()

    def add(self, new: SuffixArray) -> None:
        new.repeats(self.hit)
        for level in self.levels.values():
            level.scan(new, self.hit)
        rank = 0
        while rank in self.levels:
            new = self.levels.pop(rank).merged(new)
            rank += 1
        self.levels[rank] = new


def repeated_windows(pieces: list[bytes], batch: int = BATCH, looked: list[list[int]] | None = None) -> list[list[int]]:
    """For each segment of one anchor the window starts, inside the segment, that repeat; only `looked` ones are compared."""
    family = Family()
    text, starts, owner, window, size = [], [], [], [], 0
    for k, piece in enumerate(pieces):
        for w in range(len(piece) - SIZE + 1) if looked is None else looked[k]:
            starts.append(size + w)
            owner.append(k)
            window.append(w)
        text.append(piece)
        size += len(piece)
        if len(starts) >= batch:
            family.add(SuffixArray(b"".join(text), starts, owner, window))
            text, starts, owner, window, size = [], [], [], [], 0
    if starts:
        family.add(SuffixArray(b"".join(text), starts, owner, window))
    out: list[list[int]] = [[] for _ in pieces]
    for k, w in sorted(family.hit):
        out[k].append(w)
    return out


def repeated_by_group(group: np.ndarray, pieces: list[bytes]) -> list[list[int]]:
    """For each piece the window starts that repeat within its group; a group's pieces are neighbours.

    Windows whose hash is the only one of its kind in the group cannot repeat and are not compared.
    """
    sizes = np.array([len(x) for x in pieces], np.int64)
    many = sizes - SIZE + 1
    ends = np.cumsum(many)
    inside = np.arange(ends[-1]) - np.repeat(ends - many, many)
    h = string_hashes(np.frombuffer(b"".join(pieces), np.uint8), SIZE)[np.repeat(np.cumsum(sizes) - sizes, many) + inside]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
    with np.errstate(over="ignore"):
        h = h + np.repeat(number, many).astype(np.uint64) * np.uint64(_MULT)
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    again = n[which] > 1
    kept = np.split(inside[again], np.cumsum(np.add.reduceat(again, ends - many, dtype=np.int64))[:-1])
    looked = [x.tolist() for x in kept]
    out: list[list[int]] = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(pieces)]):
        out += repeated_windows(pieces[a:b], looked=looked[a:b]) if any(looked[a:b]) else [[]] * (b - a)
    return out


def runs(windows: list[int]) -> list[list[int]]:
    """[first, last] of neighbouring window starts."""
    out: list[list[int]] = []
    for w in windows:
        if out and out[-1][1] == w - 1:
            out[-1][1] = w
        else:
            out.append([w, w])
    return out


def _scan(docs: DataFrame) -> DataFrame:
    """(anchor, segment, n) of (text): the different segments of each text with their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                found: dict[tuple[int, int], int] = {}
                for value in batch.column(0).slice(i, 256):
                    data = value.as_py() or b""
                    for key, s, *_ in segments(data):
                        found[key, s] = found.get((key, s), 0) + 1
                keys, segs = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(segs, pa.int64()), pa.array(found.values(), pa.int64())],
                    ["anchor", "segment", "n"])

    return docs.mapInArrow(run, "anchor long, segment long, n long")


def _pieces(docs: DataFrame, slots: dict[int, bytes]) -> DataFrame:
    """(anchor, segment, piece) of the anchors that may be in the slot table, once per few texts."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Slots(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                found: dict[tuple[int, int], bytes] = {}
                for value in batch.column(0).slice(i, 256):
                    data = value.as_py() or b""
                    for key, s, a, b in segments(data, wanted):
                        if (key, s) not in found:
                            found[key, s] = data[a:b]
                keys, segs = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(segs, pa.int64()), pa.array(list(found.values()), pa.binary())],
                    ["anchor", "segment", "piece"])

    return docs.mapInArrow(run, "anchor long, segment long, piece binary")


#: Bits of the table that marks anchors in question: 4 MB whatever the input.
SLOT_BITS = 25


class Slots:
    """Bit table by the top bits of a mixed key, in parts of 32768 bits."""

    def __init__(self, parts: dict[int, bytes]):
        self.bits = np.zeros((1 << (SLOT_BITS - 15), 4096), np.uint8)
        for part, bits in parts.items():
            self.bits[part] = np.frombuffer(bits, np.uint8)
        self.bits = self.bits.reshape(-1)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def have(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _slots(keys: DataFrame) -> dict[int, bytes]:
    """Bit table of (anchor), gathered as at most 2**(SLOT_BITS - 15) rows of 4 KB."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = Slots.slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> 15).astype(np.int32)), pa.array(slots & 32767)], ["part", "bit"])

    found = keys.select("anchor").mapInArrow(run, "part int, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return {r["part"]: bytes(r["bits"]) for r in found.toLocalIterator()}


def verdicts(docs: DataFrame, hot: int = HOT, crowd: int = CROWD) -> DataFrame:
    """(anchor, segment, starts, ends): runs of repeated window starts inside a segment; null: all its windows."""
    counted = materialise(_scan(docs).groupBy("anchor", "segment").agg(F.sum("n").alias("n")), "segments")
    several = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1")
    several = materialise(several, "anchors")
    nothing = F.lit(None).cast("array<int>")
    # a segment that occurs twice repeats all its windows, whatever else its anchor has
    whole = counted.where("n > 1").select("anchor", "segment", nothing.alias("starts"), nothing.alias("ends"))
    mixed = several.where("kinds > 1")
    pieces = _pieces(docs, _slots(mixed)).groupBy("anchor", "segment").agg(F.first("piece").alias("piece"))
    pieces = materialise(pieces.join(mixed, "anchor").select("anchor", "segment", "piece", "kinds"), "pieces")

    def shards(many: DataFrame) -> int:
        return max(1, -(-(many.first()[0] or 0) // SHARD))

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("anchor")
        found = [runs(w) for w in repeated_by_group(table.column("anchor").to_numpy(), table.column("piece").to_pylist())]
        return pa.table({
            "anchor": table.column("anchor"), "segment": table.column("segment"),
            "starts": pa.array([[r[0] for r in x] for x in found], pa.list_(pa.int32())),
            "ends": pa.array([[r[1] for r in x] for x in found], pa.list_(pa.int32()))})

    shape = "anchor long, segment long, starts array<int>, ends array<int>"
    cool = pieces.where(F.col("kinds") <= hot)
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards(cool.agg(F.count("*")))))
    gathered = cool.groupBy(shard.alias("shard")).applyInArrow(judge, shape)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for key, s, piece in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns)):
                    p = int((string_hashes(np.frombuffer(piece[:SIZE], np.uint8), ANCHOR) & ~_PLACE).argmin())
                    last = len(piece) - SIZE
                    for g in range((p - min(p, last)) // BLOCK, p // BLOCK + 1):
                        high = p - g * BLOCK
                        low, up = max(0, high - BLOCK + 1), min(last, high)
                        core = xxhash.xxh3_64_intdigest(piece[high:high - BLOCK + 1 + SIZE])
                        out.append((key, s, g, core - (1 << 64) if core >> 63 else core, low, piece[low:up + SIZE]))
                columns = list(zip(*out)) if out else [()] * 6
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 ["anchor", "segment", "block", "core", "low", "piece"])

    def judge_block(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in core])
        same = np.stack([table.column(c).to_numpy() for c in core])
        group = np.concatenate(([0], np.cumsum((same[:, 1:] != same[:, :-1]).any(axis=0))))
        found = [runs(w) for w in repeated_by_group(group, table.column("piece").to_pylist())]
        lows = table.column("low").to_pylist()
        return pa.table({
            "anchor": table.column("anchor"), "segment": table.column("segment"),
            "starts": pa.array([[x + r[0] for r in f] for x, f in zip(lows, found)], pa.list_(pa.int32())),
            "ends": pa.array([[x + r[1] for r in f] for x, f in zip(lows, found)], pa.list_(pa.int32()))})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for key, s, low, piece in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns)):
                    for w in range(len(piece) - SIZE + 1):
                        d = xxhash.xxh3_128_digest(piece[w:w + SIZE])
                        out.append((key, s, low + w, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k != 2 else pa.int32()) for k, c in enumerate(columns)],
                                                 ["anchor", "segment", "w", "h1", "h2"])

    cut = pieces.where(F.col("kinds") > hot).select("anchor", "segment", "piece") \
        .mapInArrow(blocks, "anchor long, segment long, block int, core long, low int, piece binary")
    cut = materialise(cut, "blocks")
    core = ["anchor", "block", "core"]
    sizes = materialise(cut.groupBy(*core).agg(F.count("*").alias("size")).where("size > 1"), "cores")
    few = sizes.where(F.col("size") <= crowd)
    shard = F.pmod(F.xxhash64(*core), F.lit(shards(few.agg(F.sum("size")))))
    gathered = gathered.unionByName(cut.join(few, core).groupBy(shard.alias("shard")).applyInArrow(judge_block, shape))
    spread = cut.join(sizes.where(F.col("size") > crowd), core).select("anchor", "segment", "low", "piece") \
        .mapInArrow(windows, "anchor long, segment long, w int, h1 long, h2 long")
    spread = materialise(spread, "windows")
    again = spread.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    starts = F.array_sort(F.collect_set("w"))
    # each start is a run of its own here
    hot_ones = spread.join(again, ["h1", "h2"]).groupBy("anchor", "segment").agg(starts.alias("starts")) \
        .select("anchor", "segment", "starts", F.col("starts").alias("ends"))
    part = gathered.where(F.size("starts") > 0).unionByName(hot_ones)
    return whole.unionByName(part.join(whole.select("anchor", "segment"), ["anchor", "segment"], "left_anti"))


def removals(docs: DataFrame) -> DataFrame:
    """(row, spans) of (row, data): verdicts brought back to the texts, as byte ranges."""
    said = materialise(verdicts(docs.select("data")), "verdicts")
    slots = docs.sparkSession.sparkContext.broadcast(_slots(said))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Slots(slots.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for row, value in zip(batch.column(0).slice(i, 256).to_pylist(), batch.column(1).slice(i, 256)):
                    data = value.as_py() or b""
                    out += [(row, *x) for x in segments(data, wanted)]
                columns = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "anchor", "segment", "a", "b"])

    places = docs.select("row", "data").mapInArrow(run, "row long, anchor long, segment long, a long, b long")
    met = places.join(said, ["anchor", "segment"])
    spans = F.when(F.col("starts").isNull(), F.array(F.struct(F.col("a").alias("from"), F.col("b").alias("to")))).otherwise(
        F.transform(F.arrays_zip("starts", "ends"), lambda r: F.struct(
            (F.col("a") + r["starts"]).alias("from"), (F.col("a") + r["ends"] + SIZE).alias("to"))))
    return met.select("row", spans.alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept binary, spans]), one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), data.alias("data"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "numbered_texts")
    found = materialise(removals(rows).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "removals")
    flagged = with_hit(rows, slot_table(found, F.col("row")), "hit", F.col("row"))
    none = F.lit(None).cast("array<struct<from:bigint,to:bigint>>")
    ready = flagged.where("not hit").select("id", "data", none.alias("spans")).unionByName(
        flagged.where("hit").join(found, "row", "left").select("id", "data", "spans"))
    more = ", kept binary, removed array<struct<from:bigint,to:bigint>>" if keep_text else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for value, spans in zip(part.column(1), part.column(2).to_pylist()):
                    b = value.as_py()
                    merged: list[list[int]] = []
                    for s in sorted((s["from"], s["to"]) for s in spans or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    kept, at = [], 0
                    for x, y in merged:
                        kept.append(b[at:x])
                        at = y
                    kept = b"".join([*kept, b[at:]])
                    out.append((len(b), len(b) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept,
                                [{"from": x, "to": y} for x, y in merged]))
                columns = list(zip(*out)) if out else [()] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
                         pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
                last = 6 if keep_text else 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(columns[:last], types))], names[:last + 1])

    return ready.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}") \
        .withColumnRenamed("id", id_col)
