"""Operators against plain versions, on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from deskspark.llm import ann, bpe, exact_dedup, langid, line_dedup, lm, mixing, simhash, suffix_dedup, url_filter  # noqa: E402
from deskspark.session import ship  # noqa: E402

WORDS = "the of and to in that was his with for river stone garden letter music harbour winter".split()
SHAPE = "doc_id long, text string, lang string, source string, keep_id string, size int"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, sentence(rng, rng.choice([3, 8, 40, 90])), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), "x", 1) for i in range(40)]
    long = sentence(rng, 3000)
    out += [(100, None, None, None, None, None), (101, "", "en", "b", None, 2), (102, "  \n ", "de", "a", None, 2), (103, long, "en", "c", None, 3),
            (104, out[3][1].upper(), "en", "a", "y", 1), (105, out[3][1], "en", "a", "y", 1), (106, "x" * 900, "en", "a", "y", 1),
            (107, out[4][1] + " " + out[5][1], None, "é", "y", 1), (108, "ÀÉ " + out[3][1], "de", "a", "y", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def test_exact_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in exact_dedup.decisions(docs, digest=True).collect()}
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[brute.ascii_lower(t or "")].append(i)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {max(x) for x in groups.values()}
    assert exact_dedup.decisions(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "A"), (None, "b"), (None, "B"), (2, "c"), (2, "c")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.group_size, r.kept) for r in exact_dedup.decisions(df).collect())
    assert got == [("1", 2, True), ("2", 2, True), ("2", 2, True), ("None", 2, False), ("None", 2, True), ("None", 2, True)]


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = {i: len(brute.words(t)) for i, t, *_ in rows}
    total = collections.Counter()
    for i, _, _, source, *_ in rows:
        total[source] += size[i]
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, full, left = {}, set(), 1.5 * sum(total.values())
    while True:
        free = [s for s in order if s not in full]
        share = (left - sum(2 * total[s] for s in full)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if share * weight[s] > 2 * total[s]}
        if not over:
            want = {s: 2.0 * total[s] if s in full else share * weight[s] for s in order}
            break
        full |= over
    source_of = {i: s for i, _, _, s, *_ in rows}
    taken = collections.Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(size[i] for i in size if source_of[i] == s)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == {r.doc_id: r.copies for r in got if r.copies}
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0


def test_pareto_sample_follows_inclusion(spark):
    rng = np.random.default_rng(3)
    rows = [("k", i, 1, float(u), 0.8 if i % 2 else 0.2, 1000.0) for i, u in enumerate(rng.random(2000))]
    df = spark.createDataFrame(rows, "key string, id long, size long, u double, p double, rest double")
    cuts = mixing.pareto_cuts(df)
    placed = mixing._placed(df).join(cuts, "key", "left")
    got = placed.select("id", mixing.drawn(placed).alias("more")).collect()
    assert sum(r.more for r in got) == 1000
    assert sum(r.more for r in got if r.id % 2) == pytest.approx(800, abs=60)


@pytest.fixture(scope="module")
def vocabulary():
    from deskspark.llm.queries import vocabulary

    return vocabulary()


def test_bpe_matches_the_library(vocabulary):
    import tiktoken

    path, pattern = vocabulary
    ranks = bpe.read_ranks(path)
    enc = bpe.Encoder(ranks, pattern)
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = [chr(i) for i in range(300)] + [chr(i) for i in (0x1680, 0x2003, 0x2028, 0x3000, 0xfeff, 0x200b, 0x4e2d, 0x663, 0x1e900, 0x10ffff)]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in (letters, "ab ", "  \n\t'sl", "a", ["é", "中", " "])
             for n in (1, 5, 60, 200, 700) for _ in range(20)] + ["", "<|endoftext|>", "a" * 5000, sentence(rng, 3000)]
    for text, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == ref.encode_ordinary(text)
        assert enc.decode(ids) == text.encode()
        assert enc.decimal_text(ids) == ",".join(map(str, ids.tolist())).encode()


def test_bpe_job(docs, rows, empty, vocabulary):
    path, pattern = vocabulary
    coded = bpe.encode(docs, path, pattern)
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for r in coded.collect():
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest()
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, path, pattern).collect()} == texts
    assert bpe.encode(empty, path, pattern).count() == 0


def test_line_dedup(spark, empty):
    base = "a b c d e f g"
    rows = [(1, base), (2, "A B c  d e x g"), (3, base + " h\n\nq"), (4, "b c d e f g\nq\n q "), (5, None), (6, ""),
            (7, "a b c d\na b c x"), (8, "x b c d e f g\nz b c d e f g"), (9, base), (10, "p q r s t\nq r s t u\nq r s t"),
            (11, "one\ttwo three four five\r\n" * 3)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest())
           for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.line_dedup(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    # (id to order by, text); null ids come last, equal ids in the order of the rows
    rows = [(1, "a b c d e f g"), (None, "k l m n o\nclean p q r s t\nu v w x y z"), (None, "a b c d e f g\na b c d e f g\nown line of this one"),
            (None, "k l m n o\nsome other line stays here"), (5, "i j k l m n\nfirst of its id"), (5, "own text of the id\nfirst of its id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()]
    ranked = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    want = brute.line_dedup([(at, rows[k][1]) for at, k in enumerate(ranked)])
    assert sorted((a, b, hashlib.sha256(c.encode()).hexdigest()) for a, b, c in got) == sorted(want.values())
    assert all(b <= a for a, b, _ in got)


def test_line_dedup_of_files_with_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    bases = [[rng.choice("abcdefghij") for _ in range(n)] for n in (5, 5, 6, 7, 8, 9, 12, 40) for _ in range(3)]

    def line():
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[], [rng.choice("abcxyz")], [w[k], rng.choice("abcxyz")]])
        return " ".join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 5))), "kept", i, "x", i, "y", "z") for i in range(200)]
    rows.append((200, " ".join("w%d" % (k % 977) for k in range(5000)), "kept", 0, "x", 0, "y", "z"))
    rows.append((201, " ".join("w%d" % (k % 977) for k in range(5001) if k != 4000), "kept", 0, "x", 0, "y", "z"))
    shape = "doc_id long, text string, n_lines string, row long, hit string, line long, doc string, id string"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(str(tmp_path / "docs"))
    out = line_dedup.dedup_lines(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted(out.columns) == sorted(["doc_id", "text", "row", "hit", "line", "doc", "id", "n_lines", "n_dropped", "kept_text"])
    got = out.collect()
    want = brute.line_dedup([r[:2] for r in rows])
    assert {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == want
    assert sum(w[1] for w in want.values()) > 100 and all((r.row, r.hit, r.id) == (r.doc_id, "x", "z") for r in got if r.doc_id < 200)


def test_simhash(docs, rows, empty):
    import xxhash

    def plain(text):
        w = brute.words(text)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: plain(t) for i, t, *_ in rows}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if root[j] < root[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    root[i], changed = root[j], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(root.values())
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_goes_by_row(spark):
    rng = random.Random(12)
    t = [sentence(rng, 60) for _ in range(6)]
    rows = [(1, t[0]), (None, t[0]), (None, t[1]), (None, t[2]), (None, t[2]), (7, t[3]), (7, t[0]), (7, t[4]), (8, t[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(map(tuple, simhash.keep_one(df).collect()))
    assert got == collections.Counter([(1, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4])])


def test_trie_and_components(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    near = [int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base[:80]]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    got = [(min(i, j), max(i, j)) for a, b in simhash.trie_pairs(fps, 0, 3) for i, j in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (55, 60), (55, 70)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(chain).collect()}
    assert roots == {**{i: 0 for i in range(31)}, 50: 50, 60: 50, 55: 50, 70: 50}


@pytest.mark.parametrize("words", [lm.WORDS, 20])
def test_lm_base(docs, rows, words):
    counts = collections.Counter()
    tokens = {i: [*brute.words(t), None] for i, t, *_ in rows}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    got = lm.score(docs, *lm.fit(docs, words=words)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = tokens[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score <= 0


@pytest.mark.parametrize("held, words", [(lm.HELD, lm.WORDS), (lm.HELD, 20), (1 << 10, lm.WORDS), (1 << 10, 20)])
def test_lm_score_has_all_pairs(docs, rows, held, words):
    import xxhash

    tokens = {i: lm.tokens(t) for i, t, *_ in rows}
    single, pairs = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            single.update(w)
            pairs.update(zip(w, w[1:]))
    n, v = sum(single.values()), len(single)
    model, rare, few = lm.fit(docs, held=held, words=words)
    assert (model.floor_ > 1) == (held < n)

    def hashed(w):
        return np.array([xxhash.xxh64_intdigest(w)], np.uint64)

    def p(w, before):
        own = (single[w] + 1) / (n + v + 1)
        if before is None or not single[before]:
            return own
        c = model.pair_counts(lm.pair_keys(hashed(before), hashed(w)))[0] or pairs[before, w]
        return 0.6 * own + 0.4 * min(1, c / single[before])

    for r in lm.score(docs, model, rare, few).collect():
        w = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(x, b)) for x, b in zip(w, [None, *w])))


def test_lm_lookups_ask_each_key_once_a_chunk(spark, monkeypatch):
    """Words and pairs outside the model go to their shards packed and once for a chunk of texts, not once for each text."""
    rng = random.Random(12)
    rows = [(i, " ".join(str(rng.randrange(300)) for _ in range(60))) for i in range(60)] + [(None, "1 2 \x0b 3"), (5, "1 2"), (77, None), (78, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = sorted(map(str, lm.score(docs, *lm.fit(docs)).collect()))
    for chunk in (lm.CHUNK, 2000):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        model, rare, few = lm.fit(docs, held=1 << 10, words=20)
        assert model.floor_ > 1 and model.least > 1
        out = lm.score(docs, model, rare, few)
        assert "Join" not in out._jdf.queryExecution().toString() and "explode" not in out._jdf.queryExecution().toString()
        got = out.collect()
        assert len(got) == len(rows)
        for a, b in zip(sorted(map(str, got)), want):
            assert a.split(", base")[0] == b.split(", base")[0]
    answers = rare.unionByName(few)
    assert answers.columns == ["kind", "shard", "keys", "n"] and answers.count() <= 2 * model.shards


def test_lm_holds_little_of_long_texts(spark):
    """Texts of a chunk are hashed SLICE bytes at a time, and pairs reach the filter packed; the scores are those of single texts."""
    import pyarrow as pa

    rng = random.Random(21)
    long = [" ".join(f"{rng.randrange(900)}w" for _ in range(30_000)) for _ in range(24)]
    rows = [(2 * i, t) for i, t in enumerate(long)] + [(None, long[0]), (3, None), (5, ""), (6, "1w 2w"), (6, "1w 2w")]
    slices = list(lm._slices(pa.array([t for _, t in rows])))
    assert len(slices) > 2 and [x for s in slices for x in s.to_pylist()] == [t for _, t in rows]
    assert all(sum(len(x or "") + 1 for x in s.to_pylist()[:-1]) <= lm.SLICE for s in slices)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    model, rare, few = lm.fit(docs, held=1 << 16, words=300)
    assert model.floor_ > 1 and model.least > 1
    out = lm.score(docs, model, rare, few)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert "InArrow" not in out._jdf.queryExecution().toString()
    got = collections.Counter(map(str, out.collect()))
    one = collections.Counter()
    for row in (rows[0], rows[7], rows[-5], rows[-4], rows[-1]):
        alone = spark.createDataFrame([row], "doc_id long, text string").coalesce(1)
        one.update(map(str, lm.score(alone, model, rare, few).collect()))
    assert sum(got.values()) == len(rows) and not one - got


def test_lm_filter_of_packed_pairs(spark):
    """Packed counts give the filter of their (key, n) rows."""
    docs = spark.createDataFrame([(" ".join(str(i * j % 13) for j in range(60)),) for i in range(40)], "text string").coalesce(2)
    pairs = lm.counts(docs, 16).where("kind = 2")
    for floor_ in (1, 4):
        want = lm.filter_segments(lm.listed(pairs, floor_, 16), floor_, 1 << 12)
        got = lm.filter_segments(pairs, floor_, 1 << 12, 16)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 60


def test_lm_packed_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate((rng.integers(0, 2 ** 64, 5000, dtype=np.uint64), np.array([0, 2 ** 64 - 1], np.uint64))))
    for shards in (2, 64):
        parts = lm.dealt(keys, shards)
        assert np.concatenate([lm.keys_of(data, s, shards) for s, _, data in parts]).tolist() == keys.tolist()
        assert sum(len(data) for *_, data in parts) < 7.5 * len(keys) and all((keys[x] >> np.uint64(65 - shards.bit_length()) == s).all() for s, x, _ in parts)
    assert lm.dealt(keys[:0], 4) == [] and lm.unpacked(lm.packed(np.array([0, 300, 7]))).tolist() == [0, 300, 7]


def test_lm_hashes_tokens_like_the_plain_split():
    import pyarrow as pa
    import xxhash

    texts = [None, "", " \x0b a\x1c\x85B\tÀ\x00 \x00 Zz\r\n", "  x  y", "İK\u00a0  k"]
    words, place, sizes = lm._hashed(pa.array(texts))
    assert words[place].tolist() == [xxhash.xxh64_intdigest(w) for x in texts for w in lm.tokens(x)]
    assert sizes.tolist() == [len(lm.tokens(x)) for x in texts]


def test_lm_filter_holds_levels(spark):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2 ** 63, 3000, dtype=np.uint64))
    counts = rng.integers(4, 5000, len(keys))
    df = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, counts)], "key long, n long")
    held = 1 << 16
    size = 8 * held // lm.SEGMENTS
    bits = np.zeros((lm.SEGMENTS, size // 8), np.uint8)
    for r in lm.filter_segments(df, 4, held).collect():
        bits[r.segment] = np.frombuffer(r.bits, np.uint8)
    model = lm.Model(bits.reshape(-1), 4, size, np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1)
    want = 1 + np.floor(np.log2(counts / 4)).astype(int)
    got = model.pair_levels(keys)
    assert (got >= want).all() and (got == want).mean() > 0.9
    assert (model.pair_levels(rng.integers(0, 2 ** 63, 2000, dtype=np.uint64)) == 0).mean() > 0.9


def test_language_id(spark, empty):
    rng = random.Random(9)
    words = {"aa": "der die und nicht garten winter schnee".split(), "bb": "the and river stone letter music with".split()}

    def text(lang, n=40):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    rows = [(i, text(lang), lang, lang) for i in range(300) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa", ""), (901, "", "bb", ""), (902, "12 34 !!", "bb", ""), (903, text("bb", 2500), None, ""), (None, text("aa"), "aa", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.learn(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == "bb" and got[None].lang_pred == "aa"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    held = [(r.lang_pred, next(x[2] for x in rows if x[0] == i)) for i, r in got.items() if r.held_out and i < 900]
    assert held and sum(a == b for a, b in held) / len(held) > 0.97
    mixed = model.posteriors([("der winter und garten schnee nicht die der " * 2 + "the river and stone with music the letter").split()])[0].argmax(axis=1)
    assert (mixed[:14] == 0).all() and (mixed[-6:] == 1).all()
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint({900, 901, 902}) and kept.count() == len(rows) - 3
    assert langid.predict(empty, langid.learn(empty)).count() == 0


def test_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[True, True, True, False]])
    paths = list(itertools.product(range(3), repeat=3))
    weight = np.array([math.exp(sum(scores[0, i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))) for path in paths])
    post, expected, log_z = langid.forward_backward(scores, mask, moves)
    for i in range(3):
        for k in range(3):
            assert post[0, i, k] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[i] == k) / weight.sum())
    assert log_z == pytest.approx(math.log(weight.sum()))
    assert expected.sum() == pytest.approx(2)


def test_url_filter(spark):
    from deskspark.llm.queries import URL_RULES

    model = url_filter.fit(url_filter.labelled_urls(spark))
    urls = [("https://a.example.com/en/1", "example.com/en/"), ("https://WWW.example.com/en/1?x=/fr/", "www.example.com/en/"),
            ("http://b.com/de/#top", "com/"), ("http://b.com", None), ("http://x.net/es/9", "net/es/"), ("http://xnet/es/9", None),
            ("http://net/fr/", "net/fr/"), (None, None), ("no scheme", None), ("", None), ("x://h?q=://y/z", None)]
    df = spark.createDataFrame([(i, u, "clash") for i, (u, _) in enumerate(urls)], "page_id long, url string, extra string")
    got = {r.page_id: r for r in url_filter.judge(df, URL_RULES, model).collect()}
    says = {r.text: r.verdict for r in URL_RULES}
    for i, (_, rule) in enumerate(urls):
        assert got[i].rule == rule and got[i].extra == "clash"
        assert got[i].verdict == (says[rule] if rule else ("block" if got[i].block_score >= 0.5 else "allow"))
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/1") and (got[3].host, got[3].path) == ("b.com", "")
    assert (got[10].host, got[10].path) == ("h", "") and (got[7].host, got[8].path) == ("", "")
    test = [(1, "https://big-casino-club.example.org/en/7", ""), (2, "https://old-library.example.org/en/7", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(test, df.schema), (), model).collect()}
    assert got == {1: "block", 2: "allow"}


@pytest.mark.parametrize("hot, crowd", [(suffix_dedup.HOT, suffix_dedup.CROWD), (1, suffix_dedup.CROWD), (1, 2)])
def test_suffix_dedup(spark, hot, crowd, monkeypatch):
    rng = random.Random(3)
    shared = sentence(rng, 120)
    rows = [(i, sentence(rng, 60) + shared[rng.randrange(50):400 + rng.randrange(200)] + sentence(rng, 60)) for i in range(8)]
    rows += [(20, None), (21, ""), (22, "ab" * 500), (23, "z" * 650), (24, shared), (24, shared), (25, "é" * 150), (26, "q" * 199), (27, "w" * 200),
             (28, sentence(rng, 4000)), (29, "k" * 201)]
    monkeypatch.setattr(suffix_dedup.verdicts, "__defaults__", (hot, crowd))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute.repeated_bytes(rows)
    assert [g[0] for g in got] == sorted(i for i, _ in rows)
    assert {g[0]: g[1:] for g in got} == want


def test_levels_merge_like_a_counter():
    rng = random.Random(8)
    pieces = [sentence(rng, 60).encode()[:300] for _ in range(20)]
    pieces += [p[:250] + b"!" * 50 for p in pieces[:5]]
    whole = suffix_dedup.repeated_windows(pieces, batch=1 << 30)
    assert suffix_dedup.repeated_windows(pieces, batch=150) == whole and any(whole)


def test_suffix_shards_compare_only_windows_that_may_repeat(monkeypatch):
    rng = random.Random(9)
    groups = [[sentence(rng, 60).encode()[:280] for _ in range(4)] for _ in range(5)]
    for g in groups[1:4]:
        g += [g[0][:240] + b"!" * 30, g[1]]
    groups.append([groups[0][0], b"\x00" * 230])  # repeats in another group, and within one piece
    pieces = [x for g in groups for x in g]
    number = np.concatenate([[i] * len(g) for i, g in enumerate(groups)])
    compared = []
    plain = suffix_dedup.SuffixArray
    monkeypatch.setattr(suffix_dedup, "SuffixArray", lambda text, starts, *x: compared.append(len(starts)) or plain(text, starts, *x))
    got = suffix_dedup.repeated_by_group(number, pieces)
    assert sum(compared) == sum(map(len, got)) < sum(len(x) - suffix_dedup.SIZE + 1 for x in pieces)
    assert got == [w for g in groups for w in suffix_dedup.repeated_windows(g)]


def test_ann(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] + [1.0] * 15), (3300, [None] + [1.0] * 15), (None, rows[0][1])]
    rows += [(4000 + i, rows[7][1]) for i in range(201)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    hits = 0
    asked = [i for i in ids if i % 100 == 0]
    assert set(got) == set(asked)
    for q in asked:
        d = np.sqrt(((m - good[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & {int(ids[i]) for i in order})
    assert hits / (10 * len(asked)) >= 0.9
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert sorted((r.rank, r.vec_id) for r in ann.search(few, few.where("vec_id = 0")).select("rank", "vec_id").collect())[0][0] == 1
    assert ann.search(few, few.where("vec_id = 0")).count() == 3
    assert ann.search(few.limit(0), few.limit(0)).count() == 0
