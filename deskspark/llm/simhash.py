"""SimHash near-dedup: fingerprints of word shingles and a binary trie self-join by Hamming distance.

Equal fingerprints are one trie leaf with a count and a smallest id, so copies are never compared. The trie
is too large for one task, so its top is cut by the error budget: of BLOCKS blocks of bits, a pair within
`budget` differing bits agrees on KEEP = BLOCKS - budget blocks at least. For each choice of KEEP blocks the
trie over those bits first and the rest below allows no error in its top part: a top node is only ever met by
itself, and is one group of the shuffle. Below it the task builds a trie over the remaining bits and
traverses node pairs together, level by level, adding up differing bits and dropping a pair of nodes as soon
as the budget is exceeded. Leaf pairs that are left are the links.

With 5 blocks and a budget of 3 a fingerprint is sent to 10 groups, whatever the input; a group shares 25 or
26 bits, so a dense cluster of near copies is spread by the bits in which its members differ, and what meets in
one task is bounded by the fingerprints that agree on those bits, not by the number of copies. A task gives back a
spanning forest of each group's links instead of all pairs, so the output is linear in the input.

Components come from the forests by repeated hooking to the smallest neighbour (large star, small star),
each round written to the shared folder.

Null and empty texts have fingerprint zero and link like any other. Null ids take part in links and never
name a component with ids; rows that repeat an id are rows of their own. keep_one goes by row, not by id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.session import materialise

SHINGLE = 3
BUDGET = 3
BLOCKS = 5
SEED = 42
#: Node pairs expanded at a time inside a task.
FRONTIER = 1 << 20

#: Bits of every byte value, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def digests(text: str | None, shingle: int = SHINGLE) -> list[bytes]:
    """XXH64 of every shingle of a text, repeats included."""
    # of bytes, lower() changes A-Z only and split() parts at \x20 and \x09-\x0D only
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        stops, starts = [len(joined)], [0]
    else:
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(ends[:len(words) - shingle] + 1).tolist()]
        stops = [*ends[shingle - 1:].tolist(), len(joined)]
    hashed = xxhash.xxh64_digest
    return [hashed(joined[a:b], SEED) for a, b in zip(starts, stops)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash; a bit is set if it is set in over half of the shingles' XXH64, repeats included."""
    hashed = digests(text, shingle)
    if not hashed:
        return 0
    lanes = np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp), fp as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, f"id {kind}, fp long")


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """The bits of each block; blocks differ by one bit in width at most."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(edges, edges[1:])]


def top_masks(budget: int = BUDGET, blocks: int = BLOCKS) -> list[int]:
    masks = block_masks(blocks)
    return [sum(x) for x in itertools.combinations(masks, blocks - budget)]


def trie_pairs(fps: np.ndarray, mask: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of distinct fingerprints within `budget` differing bits outside `mask`.

    fps are sorted by the bits outside the mask, so a trie node is a range. The traversal starts at the
    pair (root, root) and goes down bit by bit; a node is never met by a node before it.
    """
    n = len(fps)
    levels = [b for b in range(63, -1, -1) if not mask >> b & 1]
    stack = [(0, np.array([0]), np.array([n]), np.array([0]), np.array([n]), np.zeros(1, np.int64))]
    ones = {b: np.concatenate(([0], np.cumsum((fps >> np.uint64(b)) & np.uint64(1), dtype=np.int64))) for b in levels}
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        while len(a0):
            if len(a0) > FRONTIER:
                half = len(a0) // 2
                stack.append((depth, a0[half:], a1[half:], b0[half:], b1[half:], diff[half:]))
                a0, a1, b0, b1, diff = (x[:half] for x in (a0, a1, b0, b1, diff))
            # single leaves on both sides need no more levels: compare them at once
            leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
            if leaf.any():
                i, j = a0[leaf], b0[leaf]
                near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
                if near.any():
                    yield i[near], j[near]
                rest = ~leaf
                a0, a1, b0, b1, diff = a0[rest], a1[rest], b0[rest], b1[rest], diff[rest]
            if depth == len(levels):
                break
            count = ones[levels[depth]]
            # inside a range the rows with bit 0 come first
            am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
            same = a0 == b0
            parts = []
            for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
                d = diff + more
                ok = (x1 > x0) & (y1 > y0) & (d <= budget)
                if x0 is am and more:
                    ok &= ~same  # of a node and itself, one crossed pair is enough
                parts.append((x0[ok], x1[ok], y0[ok], y1[ok], d[ok]))
            a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts))
            depth += 1


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index of each one's component."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            ri, rj = root[i], root[j]
            differ = ri != rj
            if not differ.any():
                break
            i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:  # shorten all paths
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def links(distinct: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) links between the distinct fingerprints of (fp): a spanning forest of each group's links, a < b."""
    masks = top_masks(budget, blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("trie"), F.col("fp").bitwiseAND(
        F.lit(m - (1 << 64) if m >> 63 else m)).alias("top")) for i, m in enumerate(masks)])
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.trie", "k.top")
    met = dealt.groupBy("trie", "top").agg(F.count("*").alias("n")).where("n > 1").select("trie", "top")
    rows = dealt.join(met, ["trie", "top"])

    def run(table: pa.Table) -> pa.Table:
        mask = masks[table.column("trie")[0].as_py()]
        fps = table.column("fp").to_numpy().view(np.uint64)
        below = fps & np.uint64(~mask & (1 << 64) - 1)
        fps = fps[np.argsort(below, kind="stable")]
        root = forest(len(fps), trie_pairs(fps, mask, budget))
        child = np.flatnonzero(root != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pa.table({"a": signed[child], "b": signed[root[child]]})

    found = rows.groupBy("trie", "top").applyInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest value in reach.

    Large star and small star in turn until nothing moves; every round is a table in the shared folder.
    """
    edges = materialise(edges, "links")
    for k in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b") \
            .where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b") \
            .unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        new = materialise(small, f"stars{k}")
        # done when every link goes to a root: no target is also a source
        if new.join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() \
                and new.groupBy("b").count().where("count > 1").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root")) \
                .unionByName(new.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        edges = new
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    budget: int = BUDGET, blocks: int = BLOCKS) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per input row."""
    rows = materialise(fingerprints(docs, id_col, text, shingle), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct_fps")
    roots = materialise(components(links(distinct.select("fp"), budget, blocks)), "roots")
    named = distinct.join(roots, distinct["fp"] == roots["node"])
    group = named.groupBy("root").agg(F.min("first").alias("component"))
    alone = distinct.join(roots, distinct["fp"] == roots["node"], "left_anti").withColumnRenamed("first", "component")
    classes = named.select("fp", "root").join(group, "root").select("fp", "component").unionByName(alone)
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each component stays, the one with the smallest id; columns as they came.

    Null ids come last; of rows with the same id the first row read is the smallest. Rows are told apart by a
    written row number, so a row is never dropped for another row's text.
    """
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered_documents")
    key = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    drop = near_duplicates(rows.select(key.alias("key"), F.col(text).alias("text")), "key", "text", **how) \
        .where("key.row <> component_id.row").select(F.col("key.row").alias("__row"))
    return rows.join(materialise(drop, "dropped_rows"), "__row", "left_anti").select(*docs.columns)
