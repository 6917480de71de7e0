"""Approximate nearest neighbours with balanced posting lists.

Index. Centroids are fitted on a bounded sample, the SAMPLE vectors whose id has the smallest hash: the sample
is split in halves by 2-means, largest part first and evenly at the median of the projection, until no part
is above its share (balanced parts). There are at most CENTROIDS of them, so what is broadcast has a
fixed bound. Centroids are searched by a graph in memory: each is tied to its nearest ones, and a best-first
walk keeps the WIDTH best seen. Every row is put into the posting list of its nearest centroid and, if it lies
near a boundary, into those of the next ones: up to COPIES lists whose centroid is at most (1 + SPILL) times as
far.

Search. A query takes the nearest centroids in turn as long as their distance is at most (1 + RATIO) times the
smallest (distance-ratio pruning), LISTS of them at most, but goes on until the lists hold ENOUGH rows by their
primary members, so a small table is searched whole. Queries meet the posting lists in a join by list; a list
with more than PART rows is cut in parts by hash, to each of which its queries are sent, so a list that holds
a third of all rows is many tasks. Each task computes exact distances in double precision and keeps k rows a
query; k rows a query and task are merged by a rank-limited window.

Vectors that are null, zero or hold null or non-finite components take no part, as rows and as queries; so do
rows without an id and vectors whose length is not the most frequent one's of the sample. Ties go to the
smaller id. A query never finds its own id; rows that repeat an id are found once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskspark.session import materialise

SAMPLE = 20_000
CENTROIDS = 1024
#: Sampled vectors a centroid stands for at least.
SHARE = 40
NEIGHBOURS = 16
WIDTH = 160
COPIES = 4
SPILL = 0.1
RATIO = 0.35
LISTS = 96
ENOUGH = 64
PART = 4096
K = 10
ENTRY = 8


def valid(vector: Column) -> Column:
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from the differences themselves, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 16):
        out[i:i + 16] = np.sqrt(((a[i:i + 16, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray  # where walks begin

    def nearest(self, v: np.ndarray, want: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of a vector, nearest first, by a best-first walk of the graph."""
        seen = np.zeros(len(self.centroids), bool)
        seen[self.entries] = True
        best = self.entries
        dist = np.sqrt(((self.centroids[best] - v) ** 2).sum(axis=1))
        opened = np.zeros(len(self.centroids), bool)
        while True:
            order = np.argsort(dist, kind="stable")[:width]
            best, dist = best[order], dist[order]
            todo = best[~opened[best]][:8]
            if not len(todo):
                break
            opened[todo] = True
            new = np.unique(self.graph[todo].reshape(-1))
            new = new[~seen[new]]
            seen[new] = True
            best = np.concatenate((best, new))
            dist = np.concatenate((dist, np.sqrt(((self.centroids[new] - v) ** 2).sum(axis=1))))
        return best[:want], dist[:want]


def balanced_parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Rows of x in `parts` parts of nearly equal size, by repeated halving."""
    todo = [np.arange(len(x))]
    while len(todo) < parts:
        todo.sort(key=len)
        rows = todo.pop()
        if len(rows) < 2:
            todo.append(rows)
            break
        y = x[rows]
        # 2-means from the two ends of the direction of largest spread
        a = y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = y[((y - a) ** 2).sum(axis=1).argmax()]
        for _ in range(6):
            near = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = y[near].mean(axis=0), y[~near].mean(axis=0)
        along = np.argsort(y @ (a - b), kind="stable")
        half = len(rows) // 2
        todo += [rows[along[:half]], rows[along[half:]]]
    return todo


def build(sample: np.ndarray, most: int = CENTROIDS, share: int = SHARE) -> Index:
    x = np.unique(sample, axis=0)
    parts = max(1, min(most, len(x) // share))
    c = np.array([x[rows].mean(axis=0) for rows in balanced_parts(x, parts)])
    d = _squared(c, c)
    order = np.argsort(d, axis=1, kind="stable")[:, 1:NEIGHBOURS + 1]
    if order.shape[1]:
        # ties in both directions, so no centroid is out of reach of its neighbours
        back = [[] for _ in range(len(c))]
        for i, row in enumerate(order.tolist()):
            for j in row:
                back[j].append(i)
        width = 2 * NEIGHBOURS
        both = [list(dict.fromkeys([*row, *back[i]]))[:width] for i, row in enumerate(order.tolist())]
        graph = np.array([row + [i] * (width - len(row)) for i, row in enumerate(both)])
    else:
        graph = np.zeros((len(c), 1), np.int64)
    entries = np.unique(np.linspace(0, len(c) - 1, min(ENTRY * 4, len(c))).astype(np.int64))
    return Index(c, graph, entries)


def _usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & valid(F.col("v")))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Index | None:
    """Index from (id, v): its centroids come from the `sample` rows of smallest hash; None without rows."""
    first = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").to_pylist()
    if not first:
        return None
    sizes = [len(x) for x in first]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    return build(np.array([x for x in first if len(x) == size]))


def assign(rows: DataFrame, index: Index, copies: int = COPIES, spill: float = SPILL) -> DataFrame:
    """(list, primary, id, v): the posting lists."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part.column(1))
                at, lists, primary = [], [], []
                for r, v in enumerate(x):
                    c, d = ix.nearest(v, copies, width=32)
                    near = c[d <= (1 + spill) * d[0]]
                    at += [r] * len(near)
                    lists += near.tolist()
                    primary += [True] + [False] * (len(near) - 1)
                taken = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(lists, pa.int32()), pa.array(primary, pa.bool_()), taken.column(0), taken.column(1)],
                    ["list", "primary", "id", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    size = index.centroids.shape[1]
    return rows.where(F.size("v") == size).mapInArrow(run, f"list int, primary boolean, id {kind}, v array<double>")


def route(queries: DataFrame, index: Index, sizes: dict[int, int], ratio: float = RATIO, lists: int = LISTS) -> DataFrame:
    """(list, id, v): the posting lists that each query is to search."""
    shared = queries.sparkSession.sparkContext.broadcast((index, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, rows_in = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            at, found = [], []
            for r, v in enumerate(x):
                c, d = ix.nearest(v, lists)
                held = np.cumsum([rows_in.get(k, 0) for k in c.tolist()])
                keep = (d <= (1 + ratio) * d[0]) | (np.concatenate(([0], held[:-1])) < ENOUGH)
                c = c[keep]
                if held[-1] < ENOUGH:  # few rows in all, or in what was walked: take every list
                    c = np.arange(len(ix.centroids))
                at += [r] * len(c)
                found += c.tolist()
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), taken.column(0), taken.column(1)], ["list", "id", "v"])

    kind = queries.schema["id"].dataType.simpleString()
    size = index.centroids.shape[1]
    return queries.where(F.size("v") == size).mapInArrow(run, f"list int, id {kind}, v array<double>")


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding",
           ratio: float = RATIO, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of every query, by Euclidean distance."""
    usable = _usable(rows, id_col, vector)
    asked = _usable(queries, id_col, vector)
    kind = usable.schema["id"].dataType.simpleString()
    spark = rows.sparkSession
    index = fit(usable)
    if index is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    postings = materialise(assign(usable, index), "postings")
    counts = postings.groupBy("list").agg(F.count("*").alias("n"), F.count(F.when(F.col("primary"), 1)).alias("own")).collect()
    parts = {r["list"]: -(-r["n"] // PART) for r in counts}  # at most CENTROIDS entries
    # keyed by distinct vectors, so a vector that many queries share is searched once
    asked = asked.withColumn("same", F.hash("v"), ).withColumn("same2", F.xxhash64("v"))
    asked = materialise(asked, "queries")
    one = asked.groupBy("same", "same2").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))
    wanted = route(one.select("id", "v"), index, {r["list"]: r["own"] for r in counts}, ratio, lists)
    many = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else F.create_map()
    dealt_rows = postings.select(
        "list", F.pmod(F.xxhash64("id"), F.coalesce(F.get(F.map_values(F.map_filter(many, lambda a, _: a == F.col("list"))), F.lit(0)), F.lit(1))
                       .cast("long")).cast("int").alias("part"), "id", "v")
    dealt_queries = wanted.withColumn("n", F.coalesce(F.get(F.map_values(F.map_filter(many, lambda a, _: a == F.col("list"))), F.lit(0)), F.lit(1))) \
        .select("list", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("part"), "id", "v")

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], q.column("id").type), "id": pa.array([], q.column("id").type), "score": pa.array([], pa.float64())})
        if not q.num_rows or not p.num_rows:
            return empty
        ids, at = np.unique(p.column("id").to_numpy(), return_index=True)
        x = _matrix(p.column("v").combine_chunks())[at]
        qid, qs = q.column("id").to_numpy(), _matrix(q.column("v").combine_chunks())
        out = []
        for i in range(0, len(qid), 64):
            d = exact_distances(qs[i:i + 64], x)
            for r, row in enumerate(d):
                # k others and possibly one of the query's own vector's twins
                near = np.lexsort((ids, row))[:k + 1] if len(row) <= 4 * k else _smallest(row, ids, k + 1)
                out.append((np.full(len(near), qid[i + r]), ids[near], row[near]))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pa.table({"q": pa.array(a).cast(q.column("id").type), "id": pa.array(b).cast(q.column("id").type), "score": pa.array(c)})

    found = dealt_queries.groupBy("list", "part").cogroup(dealt_rows.groupBy("list", "part")) \
        .applyInArrow(meet, f"q {kind}, id {kind}, score double")
    # a row may be found in several lists
    best = found.groupBy("q", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("q").orderBy("score", "id")
    best = best.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    # back to every query with that vector, without its own id
    named = asked.select("id", "same", "same2").join(
        one.select(F.col("id").alias("q"), "same", "same2"), ["same", "same2"]).select(F.col("id").alias("query_id"), "q").distinct()
    out = named.join(best, "q").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _smallest(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k smallest by (distance, id); ties at the border are all looked at."""
    border = np.partition(row, k - 1)[k - 1]
    near = np.flatnonzero(row <= border)
    return near[np.lexsort((ids[near], row[near]))[:k]]
