"""Embedding whitening against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from deskspark.llm import whitening


def brute(vectors, most=32):
    """{row: (deviation, whitened of each component, signs free)}, shares of the trace."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    off = x * n - s
    c = (off / n).astype(float)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return (off * off).sum(axis=1), c @ axes / np.sqrt(values), values / (values.sum() if most > c.shape[1] else np.trace(c.T @ c / n))


def rows_of(out):
    got = {}
    for r in out.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    return got


@pytest.mark.parametrize("hot", [whitening.HOT, 3])
def test_whiten(spark, hot, monkeypatch):
    monkeypatch.setattr(whitening, "HOT", hot)  # 3: the common vector is broadcast, the others meet by shuffle
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6)) @ np.diag([3, 2, 1.5, 1, 0.7, 0.4]) + 5
    vectors = [*base.tolist(), *[base[0].tolist()] * 40]
    junk = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5),
            (905, [1.0, 2.0]), (906, [2.0 ** 60] + [0.0] * 5)]
    df = spark.createDataFrame([*enumerate(vectors), *junk], "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS w", "3 AS n")
    deviation, white, share = brute(vectors)
    got = rows_of(whitening.whiten(df.repartition(5)))
    assert set(got) == set(range(100)) and all(set(v) == set(range(1, 7)) for v in got.values())
    assert all(int(got[i][k].deviation) == deviation[i] and got[i][k].n == 100 for i in got for k in got[i])
    z = np.array([[got[i][k].whitened for k in range(1, 7)] for i in range(100)])
    signs = np.sign((z * white).sum(axis=0))
    assert np.allclose(z, white * signs, rtol=1e-9, atol=1e-9)
    assert np.allclose([got[0][k].explained for k in range(1, 7)], share, rtol=1e-9)
    assert all(got[0][k].identity_error < 1e-9 for k in got[0])


def test_weights_of_one(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 3)).tolist()
    df = spark.createDataFrame([*enumerate(base), *[(100 + i, base[0]) for i in range(20)]], "vec_id long, embedding array<double>")
    got = rows_of(whitening.whiten(df, weights="one"))
    deviation, white, _ = brute([list(v) for v in {tuple(np.floor(64 * np.array(b))): b for b in base}.values()])
    assert int(got[0][1].deviation) == int(got[110][1].deviation) and got[0][1].n == 30
    assert np.isclose(abs(got[5][1].whitened), abs(white[5][0])) and got[0][1].whitened == got[107][1].whitened


def test_more_dimensions_than_components_and_wide_values(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(80, 40)) * 1e9).tolist()  # n*x and its square pass 64 bits
    got = rows_of(whitening.whiten(spark.createDataFrame([*enumerate(vectors)], "vec_id long, embedding array<double>")))
    deviation, white, share = brute(vectors)
    assert all(set(v) == set(range(1, 33)) for v in got.values())
    assert all(int(got[i][1].deviation) == deviation[i] for i in got)
    assert np.allclose([abs(got[3][k].whitened) for k in range(1, 33)], np.abs(white[3]), rtol=1e-6)
    assert np.allclose([got[3][k].explained for k in range(1, 33)], share, rtol=1e-4)


def test_nothing_to_whiten(spark):
    shape = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, shape)).count() == 0  # nothing varies
    got = whitening.whiten(spark.createDataFrame([(None, [1.0, 7.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).collect()
    assert sorted((r.vec_id is None, r.component) for r in got) == [(False, 1), (False, 1), (True, 1)]
