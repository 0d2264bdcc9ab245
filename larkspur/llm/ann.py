"""Approximate nearest neighbours by stable projections and a kd-tree.

Largest inner product is nearest distance after one more component: vectors
are divided by the largest norm and lifted onto the unit sphere. DIMENSIONS
Gaussian (2-stable) projections of that space are indexed by a kd-tree, whose
splits are fitted on a hash sample of about SAMPLE vectors and whose cells hold
all vectors. The squared projected distance of two points is their squared
distance times a chi-square variable. A query takes projected neighbours in
rising order and verifies each on the original vectors, until the next one's
projected distance lies beyond the CONFIDENCE quantile of chi-square for the
k-th distance found: a point nearer than that would, with that probability,
have come before.

On Spark: a query first searches the nearest cells (the root of their number),
which bounds the k-th distance; then every other cell whose box the stopping
test doesn't exclude. Cells of many vectors are dealt over several tasks by hash,
and so are the queries that come to a cell: its vectors are sent once for every
BLOCK queries that ask for it, and not at all if none does.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id. A vector that is shorter than
another counts as filled up with zeros. Every row counts by itself: rows that
repeat an id are candidates of each other, and each is a query of its own if its
id is one. Ties go to the smaller id. A query has fewer results if there are fewer
candidates. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.columns import picked
from larkspur.runtime import ensure_importable, written

DIMENSIONS = 16
CONFIDENCE_QUANTILE = 23.54  # 0.9 quantile of chi-square with DIMENSIONS degrees of freedom
SAMPLE = 20_000
CELL, MAX_DEPTH = 1024, 12
#: Vectors of a cell, and queries, that meet in one task at most, about.
CHUNK, BLOCK = 8192, 8192
NO_BOUND = -1e300
#: Vectors that are sent to cells in one batch: what a batch holds doesn't grow with the cells.
SENT = 1 << 14


class Tree:
    """Splits of a kd-tree in heap order, and the boxes of its cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, d = depth, sample.shape[1]
        self.axis, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        self.low, self.high = np.full((2 << depth, d), -np.inf), np.full((2 << depth, d), np.inf)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            axis = int(np.argmax(own.var(0))) if len(own) else 0
            at = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.at[node] = axis, at
            left = own[:, axis] <= at
            parts[2 * node], parts[2 * node + 1] = own[left], own[~left]
            for child in (2 * node, 2 * node + 1):
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node, axis] = self.low[2 * node + 1, axis] = at
        self.low, self.high = self.low[1 << depth :], self.high[1 << depth :]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point from each cell's box."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(1)


def matrix(vectors: pa.Array | pa.ChunkedArray, least: int = 0) -> np.ndarray:
    """Rows as a matrix, as wide as the longest of them; shorter ones end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat, rows = vectors.flatten().to_numpy(zero_copy_only=False), len(vectors)
    sizes = np.diff(vectors.offsets.to_numpy()) if rows else np.zeros(0, np.int64)
    d = max(least, int(sizes.max(initial=0)))
    if len(flat) == rows * d:
        return flat.reshape(rows, d)
    out = np.zeros((rows, d))
    out[np.arange(d) < sizes[:, None]] = flat
    return out


class Projection:
    """Gaussian (2-stable) projections of vectors lifted onto the unit sphere, and of queries."""

    def __init__(self, d: int, largest: float, seed: int):
        gauss = np.random.default_rng(seed).standard_normal((d + 1, DIMENSIONS))
        self.last, self.body, self.largest = gauss[0], gauss[1:], largest

    def points(self, x: np.ndarray) -> np.ndarray:
        y = x / self.largest
        return y @ self.body[: y.shape[1]] + np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None] * self.last

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q / norms(q)[:, None]) @ self.body[: q.shape[1]]

    def reach(self, bound: float, norm: float) -> float:
        """Projected squared distance beyond which the stopping test rules a score above the bound out."""
        return CONFIDENCE_QUANTILE * max(0.0, 2 - 2 * bound / (self.largest * norm)) + 1e-12


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, embedding as doubles) of the vectors that take part."""
    v = picked(vectors, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where("vec_id is not null and embedding is not null").where(F.coalesce(sound, F.lit(False)))
    return v.withColumn("row", F.monotonically_increasing_id())


FOUND = "query bigint, query_id bigint, vec_id bigint, score double"


def _search(k: int, held):
    """Cell-mates of queries: their k best by the stopping test."""

    def run(key, queries: pa.Table, points: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        projection = held.value
        if queries.num_rows and points.num_rows:
            x, q = matrix(points["embedding"]), matrix(queries["embedding"])
            d = max(x.shape[1], q.shape[1])
            x, q = (a if a.shape[1] == d else np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in (x, q))
            ids, rows, own_rows = points["vec_id"].to_numpy(), points["row"].to_numpy(), queries["row"].to_numpy()
            px, pq, norm = projection.points(x), projection.queries(q), norms(q)
            bounds = queries["bound"].to_numpy(zero_copy_only=False)
            square = (px * px).sum(1)
            for i in range(len(q)):
                d2 = np.maximum(0, square - 2 * (px @ pq[i]) + pq[i] @ pq[i])
                best_v, best_s = np.empty(0, np.int64), np.empty(0)
                # scores below the bound can't be among the query's k best
                bound = bounds[i]
                order = np.flatnonzero(d2 <= projection.reach(bound, norm[i]))
                order = order[np.argsort(d2[order])]
                far = d2[order]
                start, step = 0, 4 * k
                while start < len(order) and far[start] <= projection.reach(bound, norm[i]):
                    end = min(start + step, len(order))
                    end = int(np.searchsorted(far, far[end - 1] + 1e-9, "right"))  # equal vectors together
                    near = order[start:end]
                    start, step = end, 2 * step
                    s = np.einsum("ij,j->i", x[near], q[i])  # row by row, so that equal vectors tie
                    mine = (s >= bound) & (rows[near] != own_rows[i])
                    best_v, best_s = np.append(best_v, ids[near][mine]), np.append(best_s, s[mine])
                    if len(best_s) > k:
                        top = np.lexsort((best_v, -best_s))[:k]
                        best_v, best_s = best_v[top], best_s[top]
                    if len(best_s) == k:
                        bound = max(bound, best_s.min())
                out_q.append(np.full(len(best_v), i)), out_v.append(best_v), out_s.append(best_s)
        at = np.concatenate(out_q) if out_q else np.empty(0, np.int64)
        join = lambda a, kind: pa.array(np.concatenate(a) if a else np.empty(0), kind)
        asked = queries.select(["row", "query_id"]).take(pa.array(at))
        return pa.table({"query": asked["row"], "query_id": asked["query_id"], "vec_id": join(out_v, pa.int64()), "score": join(out_s, pa.float64())})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _in_parts(asked: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors of a cell with the parts (chunk, block) in which they meet."""
    sizes = points.groupBy("cell").agg((1 + F.floor(F.count("*") / CHUNK)).alias("chunks"))
    parts = sizes.join(asked.groupBy("cell").agg((1 + F.floor(F.count("*") / BLOCK)).alias("blocks")), "cell")
    parts = F.broadcast(written(parts, "parts"))  # 2^MAX_DEPTH rows at most
    own = lambda what, n: F.pmod(F.xxhash64("row"), F.col(n)).alias(what)
    each = lambda what, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(what)
    asked = asked.join(parts, "cell").select("cell", own("block", "blocks"), each("chunk", "chunks"), "row", "query_id", "embedding", "bound")
    points = points.join(parts, "cell").select("cell", each("block", "blocks"), own("chunk", "chunks"), "row", "vec_id", "embedding")
    return asked, points


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row."""
    spark = vectors.sparkSession
    ensure_importable(spark)
    vectors = written(usable(vectors, vec_id, embedding), "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    facts = vectors.agg(F.count("*").alias("n"), F.max(square).alias("largest"), F.max(F.size("embedding")).alias("d")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    projection = spark.sparkContext.broadcast(Projection(facts.d, float(np.sqrt(facts.largest)), seed))

    def projected(x: pa.Array) -> pa.Array:
        p = projection.value.points(matrix(x))
        return pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * DIMENSIONS, pa.array(p.ravel()))

    part = F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(1 << 30))
    drawn = vectors.where(part < max(1, int(min(1.0, SAMPLE / facts.n) * (1 << 30)))).select(F.arrow_udf(projected, "array<double>")("embedding").alias("p"), part.alias("part"))
    sample = np.array([r.p for r in drawn.orderBy("part").limit(2 * SAMPLE).collect()]).reshape(-1, DIMENSIONS)
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(facts.n / CELL)))))
    tree = spark.sparkContext.broadcast(Tree(sample, depth))

    def cell_of(x: pa.Array) -> pa.Array:
        return pa.array(tree.value.cells(projection.value.points(matrix(x))), pa.int64())

    placed = written(vectors.withColumn("cell", F.arrow_udf(cell_of, "bigint")("embedding")), "cells")
    queries = placed.where(is_query).select("row", F.col("vec_id").alias("query_id"), "embedding")

    def search(asked: DataFrame) -> DataFrame:
        asked, points = _in_parts(asked, placed)
        key = ["cell", "chunk", "block"]
        return asked.groupBy(*key).cogroup(points.groupBy(*key)).applyInArrow(_search(k, projection), FOUND)

    # with h of the cells first, a query finds about k h rows there and k cells / h in the others
    homes = int(np.ceil(np.sqrt(1 << depth)))

    def cells_of(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column(2))
                norm, p = norms(q), projection.value.queries(q)
                at, cells = [], []
                for i, bound in enumerate(batch.column(3).to_pylist()):
                    gaps = tree.value.gaps(p[i])
                    order = np.argsort(gaps, kind="stable")
                    own = order[:homes]
                    if not first:
                        own = order[homes:]
                        own = own[gaps[own] <= projection.value.reach(bound, norm[i])]
                    at.append(np.full(len(own), i)), cells.append(own)
                at, cells = np.concatenate(at), np.concatenate(cells)
                for start in range(0, len(at), SENT):  # a vector goes out once for each cell, but few at a time
                    rows = batch.take(pa.array(at[start : start + SENT]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells[start : start + SENT], pa.int64())], names=["row", "query_id", "embedding", "bound", "cell"])

        return run

    kind = "row bigint, query_id bigint, embedding array<double>, bound double, cell bigint"
    first = written(_ranked(search(queries.withColumn("bound", F.lit(NO_BOUND)).mapInArrow(cells_of(True), kind)), k), "first")
    bounds = first.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("bound"))
    asked = queries.join(bounds, "row", "left").select("row", "query_id", "embedding", F.coalesce("bound", F.lit(NO_BOUND)).alias("bound"))
    found = _ranked(search(asked.mapInArrow(cells_of(False), kind)).unionByName(first.drop("rank")), k)
    return found.select("query_id", "rank", "vec_id", "score")
