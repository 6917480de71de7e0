"""Language identification of words and texts with a linear-chain conditional random field.

A text is its runs of letters, lower-cased. A word's features are its affixes and inner n-grams of up to
NGRAM bytes (marks at both ends make the outer ones affixes) and the word itself (the learned lexicon), all
hashed into BUCKETS weights a label; labels of neighbours are tied by learned transitions. Words are labelled
by forward-backward in chains of CHAIN words, so memory does not depend on a text's length; a text's language
is the label with the largest sum of its words' posteriors, its score that label's share.

Fitting takes a bounded, documented sample of labelled rows: per language the DOCS documents whose id has the
smallest hash, and of each CHAINS chains spread evenly over the whole text. They are found among the SPARE x DOCS that
lie below a share of the hash range which follows from the label's count. Labels are known for texts only,
so code-switched chains are made for training: every second chain is cut and goes on with one of another
language, which is what the transitions are learned from. The sample is at most labels x DOCS x CHAINS x CHAIN
words and the model BUCKETS x labels weights, both independent of the input.

Null texts and texts without a letter are `und` with score 0, as is everything when no label is known. A null
id is never in the held-out part and never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.llm.common import id_hash
from deskspark.session import materialise

BUCKETS = 1 << 16
NGRAM = 4
CHAIN = 64
DOCS = 300
#: Rows a label's sample is drawn from, as a multiple of the rows drawn.
SPARE = 4
CHAINS = 4
STEPS = 40
UNKNOWN = "und"
#: Words remembered in a task.
CACHE = 100_000
#: A text is rejected when no language holds this share of its words' posteriors.
MIN_SCORE = 0.3

_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    found = _words(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat, starts): the buckets of each word's features, end to end."""
    coded = [b"\x02" + w.encode() + b"\x03" for w in words]
    sizes = np.array([len(x) for x in coded], np.int64)
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    word = np.repeat(np.arange(len(words)), sizes)
    left = starts[1:][word] - np.arange(len(flat))  # bytes from here to the word's end
    owners, buckets = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, NGRAM + 1):
        h = h * np.uint64(0x100000001B3) + np.concatenate((flat[n - 1:], np.zeros(n - 1, np.uint64)))
        at = np.flatnonzero(left >= n)
        owners.append(word[at])
        buckets.append(_mix(h[at] + np.uint64(n * 0x9E3779B9)))
    # the whole word: a polynomial over its bytes
    place = (np.arange(len(flat)) - starts[word]).astype(np.uint64)
    power = np.uint64(0x9E3779B97F4A7C15) * (place * np.uint64(2) + np.uint64(1))
    whole = np.add.reduceat(flat * (power ^ (power >> np.uint64(31))), starts[:-1]) if len(words) else flat
    owners.append(np.arange(len(words)))
    buckets.append(_mix(whole + np.uint64(0x51ED27)))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    _known: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "moves": self.moves, "_known": {}, "_scores": None}

    def forget(self) -> None:
        """Drop the words remembered so far."""
        self._known, self._scores = {}, None

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, starts = features(words)
        return np.add.reduceat(self.weights[flat], starts[:-1], axis=0)

    def word_scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of all words end to end, words of each text)."""
        if self._scores is None or len(self._known) > CACHE:
            self._known, self._scores = {}, np.zeros((1 << 12, len(self.labels)), np.float32)
        flat = [w for x in texts for w in x]
        at = np.fromiter(map(self._known.get, flat, repeat(-1)), np.int64, len(flat))
        gap = np.flatnonzero(at < 0).tolist()
        if gap:
            new = list({flat[i] for i in gap})
            base = len(self._known)
            if base + len(new) > len(self._scores):
                grown = np.zeros((2 * (base + len(new)), len(self.labels)), np.float32)
                grown[:base] = self._scores[:base]
                self._scores = grown
            for i in range(0, len(new), 50_000):
                part = new[i:i + 50_000]
                self._scores[base + i:base + i + len(part)] = self.emissions(part)
            self._known.update((w, base + i) for i, w in enumerate(new))
            at[gap] = [self._known[flat[i]] for i in gap]
        return self._scores[at], np.array([len(x) for x in texts], np.int64)

    def posteriors(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(P(label) of all words end to end, words of each text)."""
        scores, counts = self.word_scores(texts)
        out = np.zeros_like(scores)
        where, mask = chain_places(counts)
        step = 1 << 14
        for i in range(0, len(where), step):
            at, inside = where[i:i + step], mask[i:i + step]
            post = forward_backward(scores[at], inside, self.moves)[0]
            out[at[inside]] = post[inside]
        return out, counts

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(x) for x in texts]
        if not self.labels or not any(split):
            return [(UNKNOWN, 0.0)] * len(texts)
        post, counts = self.posteriors(split)
        sums = np.zeros((len(texts), len(self.labels)))
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        sums[full] = np.add.reduceat(post.astype(np.float64), starts, axis=0)
        best = sums.argmax(axis=1)
        return [(self.labels[b], min(1.0, float(s[b]) / n)) if n else (UNKNOWN, 0.0)
                for b, s, n in zip(best.tolist(), sums, counts.tolist())]


def chain_places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, mask) of the chains of texts whose words lie end to end; no chain spans two texts."""
    chains = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), chains)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chains) - chains, chains)
    start = (np.cumsum(counts) - counts)[text] + nth * CHAIN
    size = np.minimum(counts[text] - nth * CHAIN, CHAIN)
    mask = np.arange(CHAIN) < size[:, None]
    return np.where(mask, start[:, None] + np.arange(CHAIN), 0), mask


def forward_backward(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray):
    """(posteriors, expected moves, log of the partition function) of padded chains, in scaled probabilities."""
    n, t, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e = np.exp(scores - top)
    a = np.exp(moves)
    alpha = np.empty((n, t, k), scores.dtype)
    scale = np.ones((n, t), np.float64)
    now = e[:, 0]
    for i in range(t):
        if i:
            now = (now @ a) * e[:, i]
        total = now.sum(axis=1)
        total = np.where(mask[:, i], total, 1.0)
        now = np.where(mask[:, i, None], now / total[:, None], alpha[:, i - 1] if i else now).astype(scores.dtype)
        alpha[:, i], scale[:, i] = now, total
    beta = np.ones((n, k), scores.dtype)
    post = np.empty_like(alpha)
    expected = np.zeros((k, k), np.float64)
    for i in range(t - 1, -1, -1):
        post[:, i] = alpha[:, i] * beta
        if i:
            ahead = e[:, i] * beta
            live = mask[:, i, None]
            pair = np.where(live, ahead / scale[:, i, None], 0)
            expected += a * (alpha[:, i - 1].T.astype(np.float64) @ pair)
            beta = np.where(live, (ahead @ a.T) / scale[:, i, None], beta).astype(scores.dtype)
    post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-30)
    log_z = float((np.log(scale) * mask).sum() + (top[:, :, 0] * mask).sum())
    return post, expected, log_z


def train(chains: list[tuple[str, list[str]]], steps: int = STEPS, l2: float = 1e-6, rate: float = 0.3) -> Crf:
    """CRF from (label, words) chains of CHAIN words at most, by Adam on the likelihood of whole chains."""
    labels = sorted({x[0] for x in chains})
    k = len(labels)
    if not k:
        return Crf([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    place = {x: i for i, x in enumerate(labels)}
    made: list[tuple[list[str], list[int]]] = []
    for i, (label, words) in enumerate(chains):
        other = chains[(i * 7919 + 13) % len(chains)]
        cut = CHAIN
        if i % 2 and other[0] != label:
            cut = 1 + (i * 31) % (CHAIN - 1)
        tail = other[1][:CHAIN - min(cut, len(words))] if cut < CHAIN else []
        head = words[:cut]
        made.append((head + tail, [place[label]] * len(head) + [place[other[0]]] * len(tail)))
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for x in made for w in x[0]))}
    flat, starts = features(list(vocab))
    per_word = np.diff(starts)
    mask = np.zeros((len(made), CHAIN), bool)
    at, gold = np.zeros((len(made), CHAIN), np.int64), np.zeros((len(made), CHAIN), np.int64)
    for i, (words, tags) in enumerate(made):
        mask[i, :len(words)] = True
        at[i, :len(words)] = [vocab[w] for w in words]
        gold[i, :len(words)] = tags
    n = mask.sum()
    seen = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    m = [np.zeros_like(weights), np.zeros_like(moves)]
    v = [np.zeros_like(weights), np.zeros_like(moves)]
    hot = np.eye(k)[gold[mask]]
    for step in range(1, steps + 1):
        scores = np.add.reduceat(weights[flat], starts[:-1], axis=0)
        post, expected, _ = forward_backward(scores[at], mask, moves)
        miss = hot - post[mask]
        by_word = np.stack([np.bincount(at[mask], miss[:, j], len(vocab)) for j in range(k)], axis=1)
        spread = np.repeat(by_word, per_word, axis=0)
        grad = np.stack([np.bincount(flat, spread[:, j], BUCKETS) for j in range(k)], axis=1) / n - l2 * weights
        pull = (seen - expected) / n - l2 * moves
        for i, (x, g) in enumerate(((weights, grad), (moves, pull))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x += rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-7)
    return Crf(labels, weights.astype(np.float32), moves.astype(np.float32))


def held_out(id_col: Column) -> Column:
    return F.coalesce(id_hash(id_col) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
          docs_per_label: int = DOCS, chains_per_doc: int = CHAINS) -> Crf:
    """Fit on the bounded sample of labelled rows described above."""
    rows = docs.where(F.col(id_col).isNotNull() & (id_hash(F.col(id_col)) % 3 != 1) & F.col(lang).isNotNull())
    hashed = rows.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"),
                         F.xxhash64(F.col(id_col)).alias("h"))
    # a label's smallest hashes lie below this share of the hash range; a hot label thus sends few rows to its window
    counts = materialise(hashed.groupBy("lang").agg(F.count("*").alias("n")), "label_counts")
    share = F.least(F.lit(1.0), F.lit(float(SPARE * docs_per_label)) / F.col("n"))
    low = hashed.join(counts, "lang").where(F.col("h").cast("double") <= share * F.lit(2.0 ** 64) - F.lit(2.0 ** 63))
    first = low.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))) \
        .where(F.col("nth") <= docs_per_label).select("id").distinct()
    picked = materialise(first, "label_sample")
    texts = rows.join(picked, rows[id_col] == picked["id"], "left_semi").select(
        F.xxhash64(F.col(id_col)).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, label, value in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(value)
                total = -(-len(words) // CHAIN)
                for j in range(min(total, chains_per_doc)):
                    start = CHAIN * (j * total // min(total, chains_per_doc))
                    out.append((h, label, j, " ".join(words[start:start + CHAIN])))
            h, labels, nth, chains = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(h, pa.int64()), pa.array(labels, pa.string()), pa.array(nth, pa.int32()),
                pa.array(chains, pa.string())], ["h", "lang", "nth", "chain"])

    sample = texts.mapInArrow(cut, "h long, lang string, nth int, chain string").toArrow().to_pylist()
    # repeated ids may give more rows than asked for
    sample.sort(key=lambda r: (r["h"], r["lang"], r["nth"], r["chain"]))
    kept, counts = [], {}
    for r in sample:
        counts[r["lang"]] = counts.get(r["lang"], 0) + 1
        if counts[r["lang"]] <= docs_per_label * chains_per_doc:
            kept.append((r["lang"], r["chain"].split(" ")))
    return train(kept)


def _predicted(batches: Iterator[pa.RecordBatch], text: str, model: Crf) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Every batch with (language, score) of its rows."""
    try:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = []
            for i in range(0, batch.num_rows, 256):
                out += model.predict(batch.column(at).slice(i, 256).to_pylist())
            yield batch, out
    finally:  # the worker lives on and serves other stages
        model.forget()
        pa.default_memory_pool().release_unused()


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score), one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _predicted(batches, "text", shared.value):
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double") \
        .withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE, **how) -> DataFrame:
    """Rows whose text is in a known language, with the columns they came with; learned from their own labels."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text=text, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _predicted(batches, text, shared.value):
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[1] >= min_score for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
