"""Stored vectors in cells around pivots, and exact nearest neighbours by the triangle inequality.

A vector belongs to the cell of its nearest pivot and is stored with its distance to it, its radius. The rows of a cell are sorted by
radius and packed into blocks of BLOCK rows, so a block is a thin ring: a row of a few numbers (cell, lowest and highest radius) and
the packed ids and vectors. For a query at distance d of a pivot no row of a ring is nearer than low - d or d - high.

A search has two rounds. The first looks into the rings nearest to the query, whose k best bound the k-th distance from
above. The second visits every ring whose lower bound does not exceed that, and in a ring only the radii within the bound, which
falls as a task finds nearer rows. No row is left out that could be among the k best, so the result is exact; how much is left out
depends on the data, and `work` tells.

Rings stay where they are stored. Queries are sent to the tasks that read them, a pack at a time: PACK of them, or PACK_BYTES of
vectors. A task gives its k best of a query, and there are TASKS tasks a core at most, so what is shuffled and written grows with the queries.
Pivots are fitted on SAMPLE rows, CELLS at most; they, the extent of each cell and ring and a pack are all that a task is sent.

Vectors that are null, hold nulls or non-finite entries, or have another length than the pivots take no part, on either side. Ids
are keys: rows of a null id are not stored, of rows that share an id each is a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from deskspark.session import materialise, writing

CELLS = 1024
SAMPLE = 16_384
STEPS = 4
BLOCK = 1024
PACK, PACK_BYTES = 16_384, 8 << 20
TASKS = 3
PROBES = 4
#: Pairs whose distances are held at once, and those computed exactly at once.
STEP, EXACT = 1 << 18, 1 << 14
DIGITS = 9
#: Bytes of an Arrow batch of rings.
BATCH = 8 << 20
#: Distances of equal rows differ by rounding in their last digits; bounds are widened by this much.
MARGIN = 1e-8


@dataclass(frozen=True)
class VectorIndex:
    cells: DataFrame   # cell, center (the pivot), low, high (radii of its rows); CELLS rows at most
    blocks: DataFrame  # block, cell, low, high, n, ids, radii, vectors (all rows of the block in a line)


def _usable(items: DataFrame, vector: str) -> Column:
    """The vector in floats if it comes so, else in doubles; null if it cannot be compared."""
    wide = F.col(vector).cast("array<double>")
    finite = F.forall(wide, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    same = isinstance(getattr(items.select(vector).schema[0].dataType, "elementType", None), T.FloatType)
    return F.when((F.size(wide) > 0) & finite, F.col(vector) if same else wide)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def fit_pivots(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of `cells` groups of the sample at most, by a few steps of Lloyd's rule from evenly drawn rows."""
    rows = np.unique(sample, axis=0)
    centers = rows[np.unique(np.linspace(0, len(rows) - 1, cells).astype(int))]
    for _ in range(STEPS):
        near = _nearest_pivot(rows, centers)
        count = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        centers = sums[count > 0] / count[count > 0, None]
    return centers


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two small blocks."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _nearest_pivot(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(rows[i:i + 4096], centers).argmin(axis=1) for i in range(0, len(rows), 4096)])


def build(items: DataFrame, doc_id: str = "doc_id", vector: str = "vector") -> VectorIndex:
    """Index of (doc_id, vector), written to the shared folder. The commonest length in the sample is that of the pivots."""
    spark = items.sparkSession
    items = items.select(F.col(doc_id).alias("doc_id"), _usable(items, vector).alias("vector")) \
        .where("doc_id IS NOT NULL AND vector IS NOT NULL")
    kind, numbers = _kind(items, "doc_id"), _kind(items, "vector")
    n = items.count()
    picked = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < SAMPLE).select("vector").limit(2 * SAMPLE).collect()
    lengths = [len(r.vector) for r in picked]
    width = max(sorted(set(lengths)), key=lengths.count, default=0)
    sample = np.array([r.vector for r in picked if len(r.vector) == width]).reshape(-1, max(width, 1))
    cells = int(min(CELLS, max(1, round(n ** 0.5 / 2))))
    centers = fit_pivots(sample, cells) if len(sample) else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            cell = _nearest_pivot(x, centers)
            radius = np.sqrt(((x - centers[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(radius)], ["doc_id", "vector", "cell", "radius"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["cell", "low", "high", "n", "ids", "radii", "vectors"]

        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            radii = rows["radius"].to_numpy()
            one = [0, len(radii)]
            return pa.RecordBatch.from_arrays([
                pa.array([rows["cell"][0].as_py()], pa.int32()), pa.array([radii.min()]), pa.array([radii.max()]), pa.array([len(radii)], pa.int32()),
                pa.ListArray.from_arrays(one, pa.concat_arrays(rows["doc_id"].chunks)), pa.ListArray.from_arrays(one, pa.array(radii)),
                pa.ListArray.from_arrays([0, len(radii) * width], pa.concat_arrays([c.flatten() for c in rows["vector"].chunks]))], names)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """Full blocks of what is held, and the rest of all cells but the last, which may go on."""
            nonlocal held
            if not held:
                return
            rows = pa.Table.from_batches(held)
            cell = rows["cell"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            rest = None
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if b - a < BLOCK and b == len(cell) and not last:
                        rest = rows.slice(a, b - a)
                        break
                    yield block(rows.slice(a, min(BLOCK, b - a)))
                    a += BLOCK
            held = rest.to_batches() if rest is not None else []

        for batch in batches:
            held.append(batch)
            yield from cut(False)
        yield from cut(True)

    if not len(centers):
        return VectorIndex(spark.createDataFrame([], CELL), spark.createDataFrame([], _ring(kind, numbers)))
    placed = items.where(F.size("vector") == width).mapInArrow(assign, f"doc_id {kind}, vector {numbers}, cell int, radius double")
    # a cell of many equal rows is cut by the hash of the id
    dealt = placed.repartitionByRange("cell", "radius", F.xxhash64("doc_id")).sortWithinPartitions("cell", "radius", "doc_id")
    packed = dealt.mapInArrow(pack, f"cell int, low double, high double, n int, ids array<{kind}>, radii array<double>, vectors {numbers}")
    blocks = materialise(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "vector_blocks", free=True, batch=BATCH)
    extent = blocks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return VectorIndex(spark.createDataFrame([(r.cell, centers[r.cell].tolist(), r.low, r.high) for r in extent], CELL), blocks)


CELL = "cell int, center array<double>, low double, high double"


def _ring(kind: str, numbers: str) -> str:
    return f"block long, cell int, low double, high double, n int, ids array<{kind}>, radii array<double>, vectors {numbers}"


def store(index: VectorIndex, path: str) -> None:
    """Write an index below `path`, over what is there."""
    index.cells.write.mode("overwrite").parquet(f"{path}/cells")
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")


def load(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index; AnalysisException where there is none."""
    return VectorIndex(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/blocks"))


def load_or_build(spark: SparkSession, path: str, read_vectors: Callable[[], DataFrame]) -> VectorIndex:
    try:
        return load(spark, path)
    except AnalysisException:
        store(build(read_vectors()), path)
        return load(spark, path)


def _cells(index: VectorIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, centres, lowest and highest radius) of the cells."""
    rows = index.cells.orderBy("cell").collect()
    centers = np.array([r.center for r in rows]) if rows else np.zeros((0, 1))
    return np.array([r.cell for r in rows], np.int32), centers, np.array([r.low for r in rows]), np.array([r.high for r in rows])


def _rings(index: VectorIndex) -> np.ndarray:
    """(block, cell, low, high, n) of the rings, by cell."""
    rows = index.blocks.select("block", "cell", "low", "high", "n").orderBy("cell", "block").toArrow()
    return np.rec.fromarrays([c.to_numpy() for c in rows.columns], names=rows.column_names)


def _probes(d: np.ndarray, cells: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """(queries, PROBES): the rings nearest to each query in the PROBES cells nearest to it, by their distances of the pivots; -1 where there are fewer."""
    near = np.argsort(d, axis=1, kind="stable")[:, :PROBES]
    at = np.repeat(np.arange(len(d)), near.shape[1])
    first, last = (np.searchsorted(rings.cell, cells[near.ravel()], side) for side in ("left", "right"))
    count = last - first
    ring = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    of, far = np.repeat(at, count), np.repeat(d[at, near.ravel()], count)
    order = np.lexsort((ring, far, np.maximum(far - rings.high[ring], rings.low[ring] - far), of))
    of, ring = of[order], ring[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    out = np.full((len(d), PROBES), -1, np.int64)
    out[of[place < PROBES], place[place < PROBES]] = rings.block[ring[place < PROBES]]
    return out


def _asked(queries: DataFrame, cells, rings: np.ndarray) -> tuple[DataFrame, list[list[int]]]:
    """A written table (pack, n, ids, vectors, first) of the queries that can be compared, and what parts of it make a pack."""
    number, centers = cells[:2]
    width = centers.shape[1]
    usable = queries.select("query_id", _usable(queries, "vector").alias("vector")).where(F.size("vector") == width)
    most = max(1, min(PACK, PACK_BYTES // (8 * width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
                x = _matrix(batch.column(1), width)
                first = np.concatenate([_probes(np.sqrt(_squares(x[i:i + 1024], centers)), number, rings) for i in range(0, len(x), 1024)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(x)], pa.int32()), pa.ListArray.from_arrays([0, len(x)], batch.column(0)),
                    pa.ListArray.from_arrays([0, len(x) * width], batch.column(1).flatten()),
                    pa.ListArray.from_arrays([0, first.size], pa.array(first.ravel()))], ["n", "ids", "vectors", "first"])

    shape = f"n int, ids array<{_kind(usable, 'query_id')}>, vectors {_kind(usable, 'vector')}, first array<long>"
    packed = usable.mapInArrow(run, shape).select(F.monotonically_increasing_id().alias("pack"), "*")
    packed = materialise(packed, "asked_vectors", free=True)
    packs, n = [], most
    for r in packed.select("pack", "n").orderBy("pack").collect():
        if n + r.n > most:
            packs.append([])
            n = 0
        packs[-1].append(r.pack)
        n += r.n
    return packed, packs


def _held(asked: DataFrame, pack: list[int], width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, vectors, rings to begin with) of a pack."""
    rows = asked.where(F.col("pack").isin(pack)).toArrow()
    ids = pa.concat_arrays([c.flatten() for c in rows["ids"].chunks])
    flat = [np.concatenate([c.flatten().to_numpy() for c in rows[x].chunks]) for x in ("vectors", "first")]
    return ids, flat[0].reshape(-1, width), flat[1].reshape(len(ids), -1)


def _meet(vectors: np.ndarray, bound: np.ndarray, cells, k: int, first: np.ndarray | None, ids: pa.Array | None = None):
    """Function over (block, cell, low, high, ids, radii, vectors) batches: (query, doc_id, distance) of the k best of each query in
    what a task reads, as far as they are within the bounds, squared distances. With `first`, each query meets these rings alone. A query
    is its id, or its number where there are no ids."""
    number, centers = cells[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, limit = vectors.astype(np.float64), bound.copy()
        size = (q * q).sum(axis=1)
        at_cell, best, found, many = None, [], [], 0
        if first is not None:
            order = np.argsort(first.ravel(), kind="stable")
            asked_block, asking = first.ravel()[order], order // first.shape[1]

        def merge() -> None:
            nonlocal many
            parts = ([best] if best else []) + found
            of, exact, docs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts])
            place = np.empty(len(docs), np.int64)
            place[pc.sort_indices(docs).to_numpy()] = np.arange(len(docs))
            order = np.lexsort((place, exact, of))
            nth = np.arange(len(order)) - np.searchsorted(of[order], of[order])
            last = order[nth == k - 1]
            limit[of[last]] = np.minimum(limit[of[last]], exact[last])
            order = order[nth < k]
            best[:] = [of[order], exact[order], docs.take(pa.array(order))]
            found.clear()
            many = 0

        for batch in batches:
            for i in range(batch.num_rows):
                block, cell, low, high = (batch.column(c)[i].as_py() for c in range(4))
                docs, radii, flat = (batch.column(c)[i].values for c in (4, 5, 6))
                if cell != at_cell:
                    d, at_cell = np.sqrt(_squares(q, centers[number == cell]))[:, 0], cell
                if first is not None:
                    active = asking[slice(*np.searchsorted(asked_block, [block, block + 1]))]
                else:
                    active = np.flatnonzero(np.maximum(d - high, low - d) <= np.sqrt(limit + MARGIN) + MARGIN)
                radii, x = radii.to_numpy(), flat.to_numpy().astype(np.float64).reshape(len(docs), -1)
                rows = max(1, STEP // len(x))
                for a in (active[j:j + rows] for j in range(0, len(active), rows)):
                    reach = np.sqrt(limit[a] + MARGIN) + MARGIN
                    # of a ring sorted by radius, the part that any query here may need
                    lo, hi = np.searchsorted(radii, (d[a] - reach).min(), "left"), np.searchsorted(radii, (d[a] + reach).max(), "right")
                    squares = _squares(q[a], x[lo:hi])
                    slack = MARGIN + 1e-12 * size[a]
                    cut = limit[a] + slack
                    near = squares <= cut[:, None]
                    if hi - lo > k and near.sum() > 2 * k * len(a):
                        near = squares <= np.minimum(cut, np.partition(squares, k - 1, axis=1)[:, k - 1] + slack)[:, None]
                    at, of = np.nonzero(near)
                    if not len(at):
                        continue
                    exact = np.concatenate([((q[a[at[j:j + EXACT]]] - x[lo + of[j:j + EXACT]]) ** 2).sum(axis=1) for j in range(0, len(at), EXACT)])
                    found.append((a[at], np.round(exact, DIGITS), docs.take(pa.array(lo + of))))
                    many += len(at)
                    if many > max(STEP, 2 * k * len(q)):
                        merge()
        if found:
            merge()
        if best:
            of = ids.take(pa.array(best[0])) if ids is not None else pa.array(best[0])
            yield pa.RecordBatch.from_arrays([of, best[2], pa.array(best[1])], ["query_id", "doc_id", "distance"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("distance", "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _stored(index: VectorIndex) -> DataFrame:
    cores = index.blocks.sparkSession.sparkContext.defaultParallelism
    return index.blocks.select("block", "cell", "low", "high", "ids", "radii", "vectors").coalesce(TASKS * cores)


def _bounds(vectors: np.ndarray, first: np.ndarray, index: VectorIndex, k: int, cells) -> np.ndarray:
    """An upper bound of the k-th squared distance of each query, infinite where the nearest rings hold fewer than k rows."""
    bound = np.full(len(vectors), np.inf)
    id_kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    probed = _stored(index).mapInArrow(_meet(vectors, bound, cells, k, first), f"query_id long, doc_id {id_kind}, distance double")
    kth = _best(probed, k).where(F.col("rank") == k).select("query_id", "distance").toArrow()
    bound[kth["query_id"].to_numpy()] = kth["distance"].to_numpy()
    return bound


def search(queries: DataFrame, index: VectorIndex, k: int = 4) -> DataFrame:
    """k nearest rows by squared Euclidean distance: (query_id, doc_id, distance, rank). Exact; ties go to the lower id."""
    cells, spark = _cells(index), queries.sparkSession
    id_kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    shape = f"query_id {_kind(queries, 'query_id')}, doc_id {id_kind}, distance double"
    asked, packs = _asked(queries, cells, _rings(index)) if len(cells[0]) else (None, [])
    found = None
    with writing(spark, free=False, batch=BATCH):
        for pack in packs:
            ids, vectors, first = _held(asked, pack, cells[1].shape[1])
            bound = _bounds(vectors, first, index, k, cells)
            some = _stored(index).mapInArrow(_meet(vectors, bound, cells, k, None, ids), shape)
            some = materialise(_best(some, k).drop("rank"), "nearest", free=True)
            found = some if found is None else found.unionByName(some)
    return _best(found if found is not None else spark.createDataFrame([], shape), k)


def work(queries: DataFrame, index: VectorIndex, k: int = 4) -> DataFrame:
    """(queries, stored, visits, share): vectors in the rings that a search visits, in both rounds, and their share of all pairs.

    The second round may visit fewer, as its bounds fall on the way.
    """
    cells, rings, asking, visits = _cells(index), _rings(index), 0, 0
    asked, packs = _asked(queries, cells, rings) if len(cells[0]) else (None, [])
    rows = dict(zip(rings.block.tolist(), rings.n.tolist()))
    for pack in packs:
        ids, vectors, first = _held(asked, pack, cells[1].shape[1])
        bound = np.sqrt(_bounds(vectors, first, index, k, cells) + MARGIN) + MARGIN
        asking, visits = asking + len(ids), visits + sum(rows.get(b, 0) for b in first.ravel().tolist())
        for i in range(0, len(ids), 1024):
            d = np.sqrt(_squares(vectors[i:i + 1024].astype(np.float64), cells[1]))[:, np.searchsorted(cells[0], rings.cell)]
            visits += int(((np.maximum(d - rings.high, rings.low - d) <= bound[i:i + 1024, None]) * rings.n).sum())
    stored = int(rings.n.sum())
    share = visits / (asking * stored) if asking * stored else None
    return queries.sparkSession.createDataFrame([(asking, stored, visits, share)], "queries long, stored long, visits long, share double")
