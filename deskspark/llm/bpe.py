"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is split by the vocabulary's pattern and each match is encoded on its own. Matches not met before in
a task are laid out as padded matrices of symbol ids, bucketed by length. In each round every row finds
its leftmost pair of minimum rank by a hashed lookup, merges it and is compacted; rows without a mergeable
pair leave. A pair of ids is looked up by (left * size + right) in a hash table built from the vocabulary: all
splits of a token's bytes into two tokens.

Rows over LONG bytes (runs without blanks) would take one round per byte; there a round merges all
leftmost-first occurrences of the minimum rank at once, unless that would open a pair of the same or a lower
rank, in which case only the first is merged. Both give the same ids.

Null and empty texts have no ids. Matches are remembered per task up to CACHE entries, then forgotten, so
memory does not grow with the vocabulary of the corpus. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 64
CACHE = 150_000
#: Symbols in one padded matrix.
BLOCK = 1 << 20
NONE = np.int64(1) << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        todo, ranks_todo = np.array(keys, np.int64), np.array(values, np.int64)
        self.probes = 0
        while len(todo):
            at = self._slot(todo, self.probes)
            free = self.keys[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = todo[put], ranks_todo[put]
            todo, ranks_todo = todo[~put], ranks_todo[~put]
            self.probes += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the pair does not merge or a side is padding (negative)."""
        out = np.full(left.shape, NONE, np.int64)
        where = np.nonzero((left >= 0) & (right >= 0))
        keys = left[where] * self.size + right[where]
        found = np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        for step in range(self.probes):
            if not len(open_):
                break
            at = self._slot(keys[open_], step)
            held = self.keys[at]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        out[where] = found
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = PairTable(ranks)
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * self.pairs.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes, self.token_starts = _packed(tokens)
        self.decimal_bytes, self.decimal_starts = _packed([b"%d," % i for i in range(len(tokens))])
        self.forget()

    def forget(self) -> None:
        """Drop the matches remembered so far."""
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _merge_matrix(self, m: np.ndarray) -> np.ndarray:
        """Merge a padded matrix of byte ids (padding -1, at the right) until no row has a mergeable pair."""
        out = np.full(m.shape, -1, np.int64)
        rows = np.arange(len(m))
        ranks = self.pairs.ranks(m[:, :-1], m[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            rank = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            done = rank >= NONE
            if done.any():
                out[rows[done], :m.shape[1]] = m[done]
                rows, m, ranks, best, rank = rows[~done], m[~done], ranks[~done], best[~done], rank[~done]
                if not len(rows):
                    break
            # compaction: columns after the merged pair move one to the left
            at = np.arange(m.shape[1] - 1)
            take = at + (at > best[:, None])
            each = np.arange(len(rows))
            m = np.take_along_axis(m, take, axis=1)
            m[each, best] = rank
            if ranks.shape[1] > 1:
                ranks = np.take_along_axis(ranks, take[:, :-1], axis=1)
                left = np.where(best > 0, m[each, np.maximum(best - 1, 0)], -1)
                inner = best < m.shape[1] - 1
                right = np.where(inner, m[each, np.minimum(best + 1, m.shape[1] - 1)], -1)
                before, after = self.pairs.ranks(left, rank), self.pairs.ranks(rank, right)
                has = best > 0
                ranks[each[has], best[has] - 1] = before[has]
                ranks[each[inner], best[inner]] = after[inner]
            else:
                ranks = ranks[:, :0]
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        while len(ranks):
            rank = ranks.min()
            if rank >= NONE:
                break
            at = np.nonzero(ranks == rank)[0]
            # leftmost first without overlap: every second one of each run of neighbours
            run = np.cumsum(np.concatenate(([0], np.diff(at) != 1)))
            first = at[np.concatenate(([True], np.diff(run) > 0))]
            at = at[(at - first[run]) % 2 == 0]
            new, new_ranks = self._merged(ids, at, rank)
            if len(at) > 1:
                fresh = np.concatenate((new_ranks[new[:-1] == rank], new_ranks[new[1:] == rank]))
                if len(fresh) and fresh.min() <= rank:
                    new, new_ranks = self._merged(ids, at[:1], rank)
            ids, ranks = new, new_ranks
        return ids

    def _merged(self, ids: np.ndarray, at: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
        new = ids.copy()
        new[at] = rank
        new = np.delete(new, at + 1)
        return new, self.pairs.ranks(new[:-1], new[1:])

    def encode_matches(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, flat, counts): the matches in order of length, their ids end to end, ids of each."""
        sizes = np.array([len(x) for x in matches], np.int64)
        order = np.argsort(sizes, kind="stable")
        cut = int(np.searchsorted(sizes[order], LONG, side="right"))
        flats: list[np.ndarray] = []
        counts = np.zeros(len(order), np.int64)
        at = 0
        while at < cut:
            most = max(int(sizes[order[at]]), 1) * 5 // 4
            upto = int(np.searchsorted(sizes[order[:cut]], most, side="right"))
            upto = min(upto, at + max(1, BLOCK // most))
            rows = order[at:upto]
            width = int(sizes[rows[-1]])
            inside = np.arange(width) < sizes[rows][:, None]
            m = np.full((len(rows), width), -1, np.int64)
            m[inside] = self.byte_ids[np.frombuffer(b"".join([matches[i] for i in rows]), np.uint8)]
            m = self._merge_matrix(m)
            inside = m >= 0
            flats.append(m[inside])
            counts[at:upto] = inside.sum(axis=1)
            at = upto
        for k in range(cut, len(order)):
            ids = self._merge_long(self.byte_ids[np.frombuffer(matches[order[k]], np.uint8)])
            flats.append(ids)
            counts[k] = len(ids)
        return order, np.concatenate(flats), counts

    def _learn(self, matches: list[str]) -> None:
        order, flat, counts = self.encode_matches([x.encode() for x in matches])
        base = len(self.known)
        self.known.update((matches[j], base + i) for i, j in enumerate(order.tolist()))
        ends = self.used + np.cumsum(counts)
        self.starts = _room(self.starts, base + len(order) + 1)
        self.flat = _room(self.flat, int(ends[-1]))
        self.starts[base + 1:base + len(order) + 1] = ends
        self.flat[self.used:ends[-1]] = flat
        self.used = int(ends[-1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Matches new to the task are encoded together, so the matrices are large."""
        if len(self.known) > CACHE:
            self.forget()
        split = [self.split(x) if x else [] for x in texts]
        places = [np.fromiter(map(self.known.get, x, repeat(-1)), np.int64, len(x)) for x in split]
        gaps = [np.nonzero(at < 0)[0] for at in places]
        new = {matches[i] for matches, gap in zip(split, gaps) for i in gap.tolist()}
        if new:
            self._learn(list(new))
        out = []
        for matches, at, gap in zip(split, places, gaps):
            if len(gap):
                at[gap] = [self.known[matches[i]] for i in gap.tolist()]
            start = self.starts[at]
            out.append(self.flat[_ranges(start, self.starts[at + 1] - start)])
        return out

    def decimal_text(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        return _gather(self.decimal_bytes, self.decimal_starts, ids)[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.token_bytes, self.token_starts, ids)


def _packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in items])))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, end to end."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _gather(flat: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    return flat[_ranges(starts[ids], starts[ids + 1] - starts[ids])].tobytes()


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array with place for n entries; grows by doubling."""
    return a if len(a) >= n else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text",
           keep_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text; decoded from the ids themselves.

    `path` must be readable on the workers, as an installed package's file is.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "id {}, n_tokens long, ids_sha256 string, decoded_sha256 string{}".format(
        kind, ", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        sha = hashlib.sha256
        try:
            for whole in batches:
                # few rows at a time: texts may be long
                for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                    counts, hashed, decoded, kept = [], [], [], []
                    for ids in enc.encode(batch.column(1).to_pylist()):
                        counts.append(len(ids))
                        hashed.append(sha(enc.decimal_text(ids)).hexdigest())
                        decoded.append(sha(enc.decode(ids)).hexdigest())
                        if keep_ids:
                            kept.append(pa.array(ids.astype(np.int32)))
                    columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()),
                               pa.array(decoded, pa.string())]
                    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_ids:
                        flat = pa.concat_arrays(kept) if kept else pa.array([], pa.int32())
                        columns.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), flat))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:  # the worker lives on and serves other stages
            enc.forget()
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id_col, decoded binary) of every list of ids; null counts as empty."""
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = [enc.decode(np.array(row.as_py() or (), np.int64)) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "decoded"])

    rows = coded.select(F.col(id_col).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
