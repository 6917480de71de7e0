"""Language-model scoring with a log-frequency Bloom filter.

Counts. Tokens are the words of a text, A-Z lower-cased, then one end mark. Every task counts hashed tokens
and pairs of neighbours in numpy, adds up what it has seen until near FLUSH distinct keys, and hands on sorted keys and counts,
one row for each shard of the keys; Spark brings a shard together over the whole training part, so what is gathered grows
with the input. There are as many shards as SHARD bytes in the texts, so one takes the same memory at every size.

Model. A pair is held if its count is at least floor_, the smallest power of two for which the filter has HELD
entries at most; the histogram of the counts' magnitudes, 64 numbers, tells. A count is quantised on a logarithmic scale,
level = 1 + log2(count / floor_) rounded down, and the pair is put into the filter once for each level up to its own
(Talbot and Osborne). Since 1 + log2(x) <= x, a floor of N / HELD or more always does, at every size, so the filter has
BITS = 8 * HELD bits. A query probes level 1, 2, ... until the first
miss; a false hit overstates a count by one level with a probability of about 2 %. The filter is blocked: all
probes of a key fall into one of SEGMENTS segments, each built by one task and sent to the driver as one row. Pairs go to
their segment packed, one row for each segment and shard.

Pairs below the floor keep their exact counts in the shards; a probe without a hit is looked up there by a shuffle. With
a floor of 1 there are none, and a miss is a count of 0.

Words have exact counts. Those seen at least `least` times, the smallest power of two that WORDS of them at most reach, are
broadcast as sorted arrays; the others are looked up in their shards, once for a chunk of texts. With a `least`
of 1 there are no others.

Score. P(w | v) = (1 - L) * P(w) + L * c(v w) / c(v) with P(w) = (c(w) + 1) / (N + V + 1), where c(v w) is the
pair's dequantised count, or its exact one below the floor; L is the weight of the pair model. A text's first word and
words after one that was not trained on are scored by P(w). The text's score is the sum of log10 P.

Null and empty texts are one end mark. A null id counts as neither held out nor trained on. Repeated rows are
trained on and scored as often as they come; rows that share an id are told apart by their text.

Memory. A worker hashes SLICE bytes of text at a time. Of a chunk of texts it holds one hash and count for each different word
of a slice, and a place and a count for each token; Spark hands it BATCH bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskspark.llm.common import id_hash
from deskspark.session import materialise

HELD = 1 << 24
SEGMENTS = 256
PROBES = 5
#: Keys probed at a time.
PROBED = 1 << 17
WORDS = 1 << 20
FLUSH = 1 << 20
#: Bytes of text hashed together, and of an Arrow batch.
SLICE = 1 << 20
BATCH = 1 << 22
#: Bytes of text a shard of the counts, and a chunk of texts that are looked up together.
SHARD = CHUNK = 1 << 23
LEAST_SHARDS = 16
PAIR_WEIGHT = 0.4
END = b"\x00"
MOD, LEFT_OUT = 7, 2


def tokens(text: str | None) -> list[bytes]:
    # of bytes, lower() changes A-Z only and split() parts at \x20 and \x09-\x0D only
    return [*(text.encode().lower().split() if text else ()), END]


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019) + (left << np.uint64(7)))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different tokens, place there of each token of all texts end to end, tokens of each text)."""
    # as tokens(): A-Z only are lowered, and white space is \x20 and \x09-\x0D; a text's ends may give empty words
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    full = pc.not_equal(words, "")
    text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[full.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(text_of, minlength=len(texts)) + 1
    coded = words.filter(full).dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    different = [*different, END]  # a word like the end mark has its hash
    last = np.zeros(int(sizes.sum()), bool)
    last[np.cumsum(sizes) - 1] = True
    place = np.full(len(last), len(different) - 1)
    place[~last] = coded.indices.to_numpy()
    return np.fromiter(map(xxhash.xxh64_intdigest, different), np.uint64, len(different)), place, sizes


def _text_bytes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, with one for its end."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first place, places) of runs of the same value."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))).tolist()
    for a, b in zip(first, [*first[1:], len(values)]):
        yield a, b - a


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in turn, about SLICE bytes at a time."""
    for a, n in _runs((np.cumsum(_text_bytes(texts)) - 1) // SLICE):
        yield texts.slice(a, n)


def _different(keys: np.ndarray) -> np.ndarray:
    """Sorted different keys."""
    keys = np.sort(keys)
    return keys[np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))]


def _inner(counts: np.ndarray) -> np.ndarray:
    """True where a token has one of the same text before it."""
    inner = np.ones(int(counts.sum()), bool)
    inner[np.cumsum(counts) - counts] = False
    return inner


class _Sums:
    """Counts by key, compacted whenever the unsorted part is large."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n.astype(np.int64)))
        self.size += len(k)
        if self.size > FLUSH:
            self.compact()

    def compact(self) -> None:
        keys = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        k, at = np.unique(keys, return_inverse=True)
        self.parts = [(k, np.bincount(at, counts, len(k)).astype(np.int64))]
        self.size = len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.compact()
        out, self.parts, self.size = self.parts[0], [], 0
        return out


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 byte place by byte place, in as many places as the largest needs, after the number of places."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    return bytes([width]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, :data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T
    return out.view("<u8").reshape(-1)


def _least_key(shard: int, shards: int) -> np.uint64:
    return np.uint64(shard << (65 - shards.bit_length()))


def dealt(keys: np.ndarray, shards: int) -> list[tuple[int, slice, bytes]]:
    """(shard, its part, its keys packed) of sorted keys; a shard has one value of the top bits, and gaps are packed."""
    of = keys >> np.uint64(65 - shards.bit_length())
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
        shard = int(of[a])
        out.append((shard, slice(a, b), packed(np.diff(keys[a:b], prepend=_least_key(shard, shards)))))
    return out


def keys_of(data: bytes, shard: int, shards: int) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64) + _least_key(shard, shards)


def shards_of(texts: DataFrame) -> int:
    """A power of two that grows with the bytes of (text)."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST_SHARDS, 1 << (size // SHARD).bit_length())


def counts(texts: DataFrame, shards: int) -> DataFrame:
    """(kind, shard, keys, n, total, sizes): kind 1 tokens, 2 pairs of neighbours, over all rows of (text).

    One row a shard: keys and counts are packed, total is the sum of the counts, sizes their number by magnitude.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (_Sums(), _Sums())

        def flushed(kind: int) -> pa.RecordBatch:
            keys, n = sums[kind - 1].take()
            parts = dealt(keys, shards)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(len(parts), kind, np.int8)), pa.array([x[0] for x in parts], pa.int32()),
                pa.array([x[2] for x in parts], pa.binary()), pa.array([packed(n[x[1]]) for x in parts], pa.binary())],
                ["kind", "shard", "keys", "n"])

        for batch in batches:
            for texts in _slices(batch.column(0)):
                words, place, sizes = _hashed(texts)
                h, inner = words[place], _inner(sizes)
                sums[0].add(h)
                sums[1].add(pair_keys(h[:-1], h[1:])[inner[1:]])
                for kind, s in enumerate(sums, 1):
                    if s.size > FLUSH * 3 // 4:
                        s.compact()
                    if s.size > FLUSH * 3 // 4:
                        yield flushed(kind)
        for kind in (1, 2):
            yield flushed(kind)

    def added(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = np.concatenate([keys_of(x, shard, shards) for x in table.column("keys").to_pylist()])
        n = np.concatenate([unpacked(x) for x in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[first], np.add.reduceat(n, first)
        return pa.table({
            "kind": table.column("kind")[:1], "shard": table.column("shard")[:1],
            "keys": pa.array([dealt(keys, shards)[0][2]], pa.binary()), "n": pa.array([packed(n)], pa.binary()),
            "total": pa.array([int(n.sum())]),
            "sizes": pa.array([np.bincount(np.frexp(n.astype(float))[1] - 1).tolist()], pa.list_(pa.int64()))})

    return texts.mapInArrow(run, "kind byte, shard int, keys binary, n binary").groupBy("kind", "shard") \
        .applyInArrow(added, "kind byte, shard int, keys binary, n binary, total long, sizes array<long>")


def listed(counted: DataFrame, least: int, shards: int) -> DataFrame:
    """(key, n) of the packed counts of `least` at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data, some in zip(*(c.to_pylist() for c in batch.columns)):
                n = unpacked(some).astype(np.int64)
                keys = keys_of(data, shard, shards)[n >= least]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[n >= least])], ["key", "n"])

    return counted.select("shard", "keys", "n").mapInArrow(run, "key long, n long")


def _level_keys(keys: np.ndarray, level: int) -> np.ndarray:
    h = (keys + np.uint64(level * 0x2545F4914F6CDD1D & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _bits(keys: np.ndarray, level: int, segment_bits: int) -> list[np.ndarray]:
    """Places of each probe inside a key's segment."""
    h = _level_keys(keys, level)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(segment_bits)).astype(np.int64) for i in range(PROBES)]


def _segments(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(5)) % np.uint64(SEGMENTS)).astype(np.int64)


def filter_segments(pairs: DataFrame, floor_: int, held: int = HELD, shards: int | None = None) -> DataFrame:
    """(segment, bits): the Bloom filter of (key, n); SEGMENTS rows at most, each of 8 * held / SEGMENTS bits.

    With `shards`, pairs are packed counts as of counts().
    """
    size = 8 * held // SEGMENTS

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shards is None:
                found = [(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())]
            else:
                found = ((keys_of(x, shard, shards), unpacked(n).astype(np.int64)) for shard, x, n in zip(*(c.to_pylist() for c in batch.columns)))
            for keys, n in found:
                keys, n = keys[n >= floor_], n[n >= floor_]
                order = np.argsort(_segments(keys), kind="stable")
                keys, n = keys[order], n[order]
                of = _segments(keys)
                runs = list(_runs(of))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(of[a]) for a, _ in runs], pa.int32()), pa.array([packed(keys[a:a + k]) for a, k in runs], pa.binary()),
                    pa.array([packed(n[a:a + k]) for a, k in runs], pa.binary())], ["segment", "keys", "n"])

    def run(table: pa.Table) -> pa.Table:
        keys, n = (np.concatenate([unpacked(x) for x in table.column(c).to_pylist()]) for c in ("keys", "n"))
        levels = 1 + np.floor(np.log2(n / floor_)).astype(np.int64)
        bits = np.zeros(size, np.uint8)
        for level in range(1, int(levels.max()) + 1):
            for place in _bits(keys[levels >= level], level, size):
                bits[place] = 1
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    return pairs.select(*(("key", "n") if shards is None else ("shard", "keys", "n"))) \
        .mapInArrow(sent, "segment int, keys binary, n binary").groupBy("segment").applyInArrow(run, "segment int, bits binary")


@dataclass
class Model:
    filter: np.ndarray
    floor_: int
    segment_bits: int
    word_keys: np.ndarray  # sorted hashes of the frequent words
    word_counts: np.ndarray
    tokens: int
    distinct: int
    least: int = 1
    shards: int = LEAST_SHARDS

    def pair_levels(self, keys: np.ndarray, most: int = 64) -> np.ndarray:
        """Probe levels upward until the first miss, for few keys at a time."""
        parts = [self._levels(keys[i:i + PROBED], most) for i in range(0, len(keys), PROBED)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    def _levels(self, keys: np.ndarray, most: int) -> np.ndarray:
        levels = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        base = _segments(keys) * self.segment_bits
        level = 1
        while len(live):
            hit = np.ones(len(live), bool)
            for place in _bits(keys[live], level, self.segment_bits):
                at = base[live] + place
                hit &= (self.filter[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[hit]
            levels[live] = level
            level += 1
            if level > most:
                break
        return levels

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Dequantised counts (the geometric middle of a level); 0 for pairs that are not held."""
        levels = self.pair_levels(keys)
        return np.where(levels > 0, np.maximum(1.0, self.floor_ * np.exp2(levels - (0.5 if self.floor_ > 1 else 1.0))), 0.0)

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, 0 for the rest."""
        if not len(self.word_keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
        return np.where(self.word_keys[at] == keys, self.word_counts[at], 0)

    def log_p(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.distinct + 1.0))


def trained(id_col: Column) -> Column:
    return F.coalesce(id_hash(id_col) % MOD != LEFT_OUT, F.lit(False))


def held_out(id_col: Column) -> Column:
    return F.coalesce(id_hash(id_col) % MOD == LEFT_OUT, F.lit(False))


def smallest(sizes: dict[int, int], cost, most: int) -> int:
    """The smallest power of two 2**j so that cost(b - j) of all sizes[b], b >= j, add up to `most` at most."""
    j = 0
    while sum(n * cost(b - j) for b, n in sizes.items() if b >= j) > most:
        j += 1
    return 1 << j


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: int = HELD,
        words: int = WORDS) -> tuple[Model, DataFrame, DataFrame]:
    """(model, rare, few): the latter are the packed exact counts of the words and of the pairs, for those not in the model."""
    texts = docs.where(trained(F.col(id_col))).select(F.col(text).cast("string").alias("text"))
    shards = shards_of(texts)
    found = materialise(counts(texts, shards), "ngram_counts", free=True, batch=BATCH)
    sizes: dict[int, dict[int, int]] = {1: {}, 2: {}}
    for row in found.select("kind", F.posexplode("sizes").alias("b", "n")).groupBy("kind", "b").agg(F.sum("n").alias("n")).collect():
        sizes[row["kind"]][row["b"]] = row["n"]
    n, v = found.where("kind = 1").agg(F.sum("total")).first()[0] or 0, sum(sizes[1].values())
    floor_ = smallest(sizes[2], lambda levels: levels + 1, held)
    least = smallest(sizes[1], lambda levels: 1, words)
    words_of, pairs_of = found.where("kind = 1"), found.where("kind = 2")
    size = 8 * held // SEGMENTS
    bits = np.zeros((SEGMENTS, size // 8), np.uint8)
    segments = materialise(filter_segments(pairs_of, floor_, held, shards), "filter", free=True, batch=BATCH)
    for row in segments.toLocalIterator():
        bits[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    top = listed(words_of, least, shards).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = Model(bits.reshape(-1), floor_, size, keys[order], top.column("n").to_numpy()[order], n, v, least, shards)
    packs = ["kind", "shard", "keys", "n"]
    return model, words_of.select(*packs), pairs_of.select(*packs)


def _numbered(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, int]:
    """(chunk of each row, bytes so far) of (part, text, ...): a part's rows in turn, CHUNK bytes a chunk."""
    ends = at + np.cumsum(_text_bytes(batch.column("text")))
    return (batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64) << 32) + (ends - 1) // CHUNK, int(ends[-1])


def _scores(m: Model, sizes: np.ndarray, inner: np.ndarray, count: np.ndarray, pair: np.ndarray, pair_weight: float) -> list[np.ndarray]:
    """[n_tokens, n_known, base_score, score] of texts by the counts of their tokens and of their pairs."""
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(inner)
    p = (count + 1.0) / (m.tokens + m.distinct + 1.0)
    before, own = count[at - 1], p[at]
    ratio = np.minimum(1.0, pair / np.maximum(before, 1))
    mixed = p.copy()
    mixed[at] = np.where(before > 0, (1 - pair_weight) * own + pair_weight * ratio, own)
    return [sizes, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(m.log_p(count), starts),
            np.add.reduceat(np.log10(mixed), starts)]


def score(docs: DataFrame, model: Model, rare: DataFrame, few: DataFrame, id_col: str = "doc_id", text: str = "text",
          pair_weight: float = PAIR_WEIGHT) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    If the model holds all words and pairs, one scan scores the texts. Else a scan sends the different words and pairs
    of each chunk of texts that the model does not hold to their shards, which answer with counts in the order asked; the
    texts are then brought together with the answers of their chunk. Both read `docs`, so it must give the same rows
    in the same partitions and order twice, as a stored table does; other rows than were asked for are an error.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    shape = f"id {kind}, n_tokens long, n_known long, base double, score double"
    names = ["id", "n_tokens", "n_known", "base", "score"]
    shards = model.shards

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            found = []
            for texts in _slices(whole.column(1)):
                words, place, sizes = _hashed(texts)
                h, inner = words[place], _inner(sizes)
                found.append(_scores(m, sizes, inner, m.frequent(words)[place], m.pair_counts(pair_keys(h[:-1], h[1:])[inner[1:]]), pair_weight))
            if found:
                yield pa.RecordBatch.from_arrays([whole.column(0), *(pa.array(np.concatenate(x)) for x in zip(*found))], names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            if batch.num_rows:
                chunk, at = _numbered(batch, at)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(chunk)], ["id", "text", "chunk"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, none = shared.value, np.zeros(0, np.uint64)
        at, now, unheld = 0, None, ([none], [none])

        def asked() -> pa.RecordBatch:
            out = []
            for k, found in enumerate(unheld, 1):
                keys = _different(np.concatenate(found))
                found[:] = [none]
                out += [(now, k, s, data) for s, _, data in dealt(keys, shards)]
            types = [pa.int64(), pa.int8(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["chunk", "kind", "shard", "keys"])

        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, at = _numbered(batch, at)
            for a, n in _runs(chunk):
                if now is not None and chunk[a] != now:
                    yield asked()
                now = int(chunk[a])
                for texts in _slices(batch.column("text").slice(a, n)):
                    words, place, sizes = _hashed(texts)
                    if m.least > 1:
                        unheld[0].append(words[m.frequent(words) == 0])
                    if m.floor_ > 1:
                        h = words[place]
                        pairs = pair_keys(h[:-1], h[1:])[_inner(sizes)[1:]]
                        unheld[1].append(pairs[m.pair_levels(pairs, 1) == 0])
        if now is not None:
            yield asked()

    def answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
        keys, n, out = np.zeros(1, np.uint64), np.zeros(1, np.uint64), []
        for shard, data, some in zip(*(counted.column(c).to_pylist() for c in ("shard", "keys", "n"))):
            keys, n = keys_of(data, shard, shards), unpacked(some)
        for chunk, k, shard, data in zip(*(asked.column(c).to_pylist() for c in ("chunk", "kind", "shard", "keys"))):
            want = keys_of(data, shard, shards)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            out.append((chunk, k, shard, packed(np.where(keys[at] == want, n[at], 0)), int(want.sum(dtype=np.uint64).view(np.int64))))
        types = [pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.int64()]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["chunk", "kind", "shard", "n", "sum"])

    def judge(texts: pa.Table, answers: pa.Table) -> pa.Table:
        m = shared.value
        got = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "n", "sum"))))
        if not texts.num_rows:
            raise RuntimeError("the texts came in other partitions when read again; store them first")
        none, parts, unheld = np.zeros(0, np.uint64), [], ([], [])
        for x in texts.column("text").chunks:
            for some in _slices(x):
                words, place, sizes = _hashed(some)
                h, known = words[place], m.frequent(words)
                pairs = pair_keys(h[:-1], h[1:])[_inner(sizes)[1:]]
                pair = m.pair_counts(pairs)
                parts.append((words, place.astype(np.int32), sizes, known, pair))
                unheld[0].append(words[known == 0])
                unheld[1].append(pairs[pair == 0] if m.floor_ > 1 else none)
        looked: list[tuple[np.ndarray, np.ndarray]] = []
        for k, bound in ((1, m.least), (2, m.floor_)):
            want = _different(np.concatenate(unheld[k - 1])) if bound > 1 else none
            unheld[k - 1].clear()
            n = np.concatenate([none, *(unpacked(x[2]) for x in got if x[0] == k)])
            seen = np.array([x[3] for x in got if x[0] == k], np.int64).view(np.uint64).sum(dtype=np.uint64)
            if len(n) != len(want) or seen != want.sum(dtype=np.uint64):
                raise RuntimeError("the texts came in another order when read again; store them first")
            looked.append((want, n))
        found = []
        for words, place, sizes, known, pair in parts:
            h, inner = words[place], _inner(sizes)
            for keys, counted, (want, n) in ((words, known, looked[0]), (pair_keys(h[:-1], h[1:])[inner[1:]], pair, looked[1])):
                if len(want):
                    open_ = np.flatnonzero(counted == 0)
                    counted[open_] = n[np.searchsorted(want, keys[open_])]
            found.append(_scores(m, sizes, inner, known[place], pair, pair_weight))
        return pa.table([texts.column("id"), *(pa.array(np.concatenate(x)) for x in zip(*found))], names=names)

    if model.floor_ == 1 and model.least == 1:
        out = rows.mapInArrow(scan, shape)
    else:
        placed = rows.withColumn("part", F.spark_partition_id())
        asked = placed.mapInArrow(ask, "chunk long, kind byte, shard int, keys binary")
        counted = rare.unionByName(few).groupBy("kind", "shard")
        answers = asked.groupBy("kind", "shard").cogroup(counted).applyInArrow(answer, "chunk long, kind byte, shard int, n binary, sum long")
        answers = materialise(answers, "answers", free=True, batch=BATCH)
        numbered = placed.mapInArrow(number, f"id {kind}, text string, chunk long")
        out = numbered.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, shape)
        out = materialise(out, "scores", free=True, batch=BATCH)
        shared.unpersist()
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
