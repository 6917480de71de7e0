"""Embedding whitening by the weighted covariance of distinct vectors.

Every entry c of a vector becomes the whole number x = floor(SCALE * c) + SHIFT, equal x vectors are one row with a count, and
all later passes read these distinct rows: sums of x (exact), the covariance as a weighted product of centred blocks of rows,
and the whitened vector, made once for each. The rows of the input get them by a join on x.

The fit weight of a distinct vector is its count (`weights="count"`, the fit list is all vectors) or one (`weights="one"`).
Centring comes before multiplying: a block is n*x - S, whole numbers, divided by n. Each task adds up its blocks and gives back
one matrix, cell by cell; what reaches the driver are the d sums and the d*(d+1)/2 cells, however many rows there are. The
eigenvectors are signed so that their largest entry (the first, of equal ones) is positive.

A vector that a large share of all rows has is one distinct row, counted before the shuffle; for the join back, the vectors
with more than 1/HOT of all rows, HOT at most, are broadcast and the others meet by shuffle.

Rows take no part if the vector is null, empty, or holds a null, non-finite or unrepresentable entry (of 2**56 or more in size),
or if it has another length than `dim` (by default the commonest length, of equally common ones the shortest). Components
whose eigenvalue is zero in double precision, as where all vectors are equal, have no whitened value and are left out; an empty
input gives an empty result. Null and repeated ids are rows as any other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.session import materialise

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
HOT = 1024
#: Entries of this size or more have no x among the longs.
LARGEST = 2.0 ** 56
#: Rows of a block that is multiplied at a time.
BLOCK = 8192


def fixed_vectors(rows: DataFrame, id_col: str, vector: str, dim: int | None) -> DataFrame:
    """(id, x) of the rows that take part, written."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    out = rows.select(F.col(id_col).alias("id"), F.when((F.size(vector) > 0) & usable, x).alias("x")).where("x is not null")
    out = materialise(out, "fixed_vectors")
    if dim is None:
        common = out.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        dim = common["d"] if common else 0
    return out.where(F.size("x") == dim)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(vectors, weights, rows) of (vector, weight, ...) batches."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False), batch


def _exact(*sizes: int):
    """int64 where a product of these sizes fits, Python's integers elsewhere."""
    product = 1
    for s in sizes:
        product *= max(1, int(s))
    return np.int64 if product < 1 << 62 else object


def sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """(n, S): the weight of all vectors of (x, w) and the weighted sum of each dimension, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x, w, _ in _blocks(batches):
            kind = _exact(np.abs(x).max(), w.sum())
            part = (x.astype(kind) * w.astype(kind)[:, None]).sum(axis=0).astype(object)
            n, total = n + int(w.sum()), part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))],
                ["i", "v"])

    cells = distinct.select("x", "w").mapInArrow(run, "i int, v decimal(38,0)")
    got = {r.i: int(r.v) for r in cells.groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    return got.pop(-1, 0), [got[i] for i in sorted(got)]


def means(vectors: DataFrame, n: int, width: int) -> np.ndarray:
    """Weighted mean of (z, w), z of `width` doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for z, w, _ in _blocks(batches):
            total += w.astype(np.float64) @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["i", "v"])

    out = np.zeros(width)
    for r in vectors.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v / n
    return out


def covariance(vectors: DataFrame, n: int, width: int, centred) -> np.ndarray:
    """Weighted covariance, divisor n, of the vectors of (vector, w); `centred` takes the mean off a block."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for v, w, _ in _blocks(batches):
            c = centred(v)
            total += (c * w.astype(np.float64)[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(range(len(upper[0])), pa.int32()), pa.array(total[upper])], ["i", "v"])

    cells = np.zeros(len(upper[0]))
    for r in vectors.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        cells[r.i] = r.v / n
    out = np.zeros((width, width))
    out[upper] = cells
    return out + np.triu(out, 1).T


def centring(n: int, total: list[int]):
    """x - S/n of a block of x, and n*x - S in whole numbers."""
    peak = max((abs(v) for v in total), default=0)

    def whole(x: np.ndarray) -> np.ndarray:
        kind = _exact(max(peak, int(np.abs(x).max()) * n), 2)
        return x.astype(kind) * n - np.array(total, object).astype(kind)

    return (lambda x: (whole(x) / n).astype(np.float64)), whole


def axes(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, shares of the trace) of the first `most` components that vary."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = np.trace(v)
    k = min(most, int((values > trace * len(v) * np.finfo(float).eps).sum())) if trace > 0 else 0
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values, vectors, values / trace if k else values


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           weights: str = "count", dim: int | None = None) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    deviation is the decimal sum over the dimensions of (n*x - S)**2, identity_error the largest entry of the whitened vectors'
    covariance over the fit list minus the identity.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    fixed = fixed_vectors(rows, id_col, vector, dim)
    distinct = materialise(
        fixed.groupBy("x").agg(F.count("*").alias("rows"))
        .select("x", F.col("rows") if weights == "count" else F.lit(1).cast("long").alias("rows"), F.col("rows").alias("hits"))
        .toDF("x", "w", "hits"), "distinct_vectors")
    n, total = sums(distinct)
    named = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return rows.sparkSession.createDataFrame([], named)
    centred, whole = centring(n, total)
    values, vectors, explained = axes(covariance(distinct.select("x", "w"), n, len(total), centred), components)
    onto = vectors / np.sqrt(values)
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, batch in _blocks(batches):
            off = whole(x)
            wide = off.astype(_exact(np.abs(off).max(), np.abs(off).max(), x.shape[1]))
            deviation = [Decimal(int(v)) for v in (wide * wide).sum(axis=1)]
            z = (off / n).astype(np.float64) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [lists, batch.column(1), batch.column(0), batch.column(2), pa.array(deviation, pa.decimal128(38, 0))],
                ["z", "w", "x", "hits", "deviation"])

    done = materialise(distinct.mapInArrow(run, "z array<double>, w long, x array<long>, hits long, deviation decimal(38,0)"), "whitened_vectors")
    error = 0.0
    if k:
        mean = means(done.select("z", "w"), n, k)
        error = float(np.abs(covariance(done.select("z", "w"), n, k, lambda z: z - mean) - np.eye(k)).max())
    most = distinct.agg(F.sum("hits")).first()[0] / HOT
    made = done.select("x", "z", "deviation", (F.col("hits") > most).alias("hot"))
    hot = materialise(made.where("hot").drop("hot"), "hot_vectors")  # fewer than HOT by the sum of their rows
    first = fixed.join(F.broadcast(hot), "x", "left")
    rest = first.where("z is null").select("id", "x").join(made.where("not hot").drop("hot"), "x")
    met = first.where("z is not null").select("id", "z", "deviation").unionByName(rest.select("id", "z", "deviation"))
    shares = F.array(*[F.lit(float(e)) for e in explained]) if k else F.array().cast("array<double>")
    return met.select("id", "deviation", F.posexplode("z").alias("pos", "whitened")).select(
        F.col("id").alias(id_col), (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))
