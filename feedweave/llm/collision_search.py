"""Nearest vectors by inner product with collision-counting hashing (query-centred windows, virtual rehashing).

Inner product becomes distance: vectors get one more component that brings
them all to the largest length, and a query is scaled to it; the nearest by
distance are then those of the largest inner product.

The index is dealt to blocks. In each, one sorted array per projection holds
the block's projected vectors. A query opens a window around its own
projection in each array. Windows grow by a constant factor (virtual rehashing:
nothing is hashed anew), a vector's collisions are the windows that hold its
place in the sorted arrays, and when they exceed the threshold its inner product
is computed on the original vectors, once. A query begins with windows a step
narrower than those that ended the search before it. A block's search ends
when the windows are wide enough for the k-th nearest found: then a vector
nearer than that has exceeded the threshold with high probability. Every row is
indexed; queries meet every block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of an index block, queries of a query block.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Share of a vector's windows that must hold it.
THRESHOLD = 0.5
#: The search ends when half a window is at least so many times the distance of the k-th nearest found.
ENOUGH = 0.85
#: First half width as a share of the common length, and growth of the windows.
FIRST, GROWTH = 0.4, 1.1


def projections(dim: int, count: int, seed: int) -> np.ndarray:
    """Rows are directions: orthonormal bases, scaled so that a distance's projection has that distance as its deviation."""
    rng = np.random.Generator(np.random.PCG64(seed))
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.vstack(bases)[:count] * math.sqrt(dim)


class CollisionIndex:
    """Sorted projections of a block of vectors (already of one length), and each vector's place in every one of them."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray):
        self.directions = directions
        values = directions @ vectors.T
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=1)
        self.n = len(vectors)
        # in as few bytes as hold n: counting walks through all of them
        self.place = np.empty(order.shape, dtype=np.min_scalar_type(self.n))
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=self.place.dtype)[None, :], axis=1)
        self._past, self._held = np.empty(self.n, dtype=self.place.dtype), np.empty(self.n, dtype=bool)

    def windows(self, queries: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (query, half width, projection) of each window, all found by binary search."""
        centres = self.directions @ queries.T
        ends = [[self.sorted[j].searchsorted((c[:, None] + side * halves).ravel()).reshape(len(c), -1) for j, c in enumerate(centres)] for side in (-1, 1)]
        return np.stack(ends[0], axis=2), np.stack(ends[1], axis=2)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of the windows (first and last place by projection) hold each vector."""
        count = np.zeros(self.n, dtype=np.min_scalar_type(len(low)))
        held = self._held.view(np.uint8)
        for place, first, width in zip(self.place, low.astype(self.place.dtype), (high - low).astype(self.place.dtype), strict=True):
            # without sign, places before the first are beyond any width
            np.subtract(place, first, out=self._past)
            np.less(self._past, width, out=self._held)
            np.add(count, held, out=count)
        return count

    def search(self, low: np.ndarray, high: np.ndarray, halves: np.ndarray, k: int, score, distance, threshold: float, enough: float, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows verified for one query, their scores, and which windows ended the search; low and high are its windows.

        score(rows) is exact; distance(scores) turns them into distances. The
        last windows hold everything. The search ends with the first windows
        that are wide enough. As each holds the ones before, it may begin with
        any of them (start) and go either way: the same ones end it.
        """
        least = math.ceil(threshold * low.shape[1])
        scores, done = np.zeros(self.n), np.zeros(self.n, dtype=bool)

        def verified(i: int) -> tuple[np.ndarray, bool]:
            found = np.flatnonzero(self.collisions(low[i], high[i]) >= least)
            new = found[~done[found]]
            if len(new):
                scores[new] = score(new)
                done[new] = True
            return found, len(found) >= k and halves[i] >= enough * np.partition(distance(scores[found]), k - 1)[k - 1]

        i = start
        found, ended = verified(i)
        if ended:
            while i:
                narrower, ended = verified(i - 1)
                if not ended:
                    break
                found, i = narrower, i - 1
        else:
            while not ended and i + 1 < len(halves):
                i += 1
                found, ended = verified(i)
        return found, scores[found], i


def half_widths(longest: float, reach: float) -> np.ndarray:
    """Half widths from the first on, growing by the constant factor; the last one reaches everything."""
    steps = max(1, math.ceil(math.log(max(reach, longest) / (FIRST * longest)) / math.log(GROWTH)))
    return np.append(FIRST * longest * GROWTH ** np.arange(steps), math.inf)


def _usable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", projections_count: int | None = None,
            threshold: float = THRESHOLD, enough: float = ENOUGH, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), id, score: for each query row the k rows found with the largest inner product.

    ``is_query`` is a condition on the input's columns. Candidates are all rows
    with another id. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do those whose length isn't the most frequent
    one (of equally frequent ones, the largest). Rows that repeat an id and its
    vector count once; rows without an id can't be queries but are candidates.
    Equal scores: the smaller id is nearer. Fewer than k candidates: all of
    them. An empty table gives an empty result. Other columns are not read.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("query"))
    sizes = plain.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    usable = plain.where(_usable(F.col("v"), dim)).withColumn("query", F.coalesce("query", F.lit(False)) & F.col("id").isNotNull()).dropDuplicates(["id", "v"])
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    seen = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q"), F.max(norm).alias("norm")).first()
    index_blocks, query_blocks = max(1, math.ceil(seen["n"] / index_block)), max(1, math.ceil(seen["q"] / query_block))
    longest = math.sqrt(seen["norm"] or 1.0)
    directions = projections(dim + 1, projections_count or max(64, dim + 1), seed) if dim else np.zeros((0, 1))

    def lengthened(x: np.ndarray, scaled: bool) -> np.ndarray:
        squares = np.einsum("ij,ij->i", x, x)
        if scaled:
            return np.hstack([x * (longest / np.sqrt(squares))[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(longest ** 2 - squares, 0.0))[:, None]])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            index = left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            queries = right.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            ids = left.column("id").to_numpy(zero_copy_only=False)
            missing = left.column("id").is_null().to_numpy()
            ids = np.where(missing, np.iinfo(np.int64).max, ids).astype(np.int64)
            found = CollisionIndex(lengthened(index, False), directions)
            # no two projections are farther apart than the vectors
            halves = half_widths(longest, 2 * longest * math.sqrt(dim + 1))
            own_ids, targets = right.column("id").to_pylist(), lengthened(queries, True)
            # most searches end with the same windows or nearly so
            ended = 0
            for at in range(0, len(own_ids), 256):
                lows, highs = found.windows(targets[at:at + 256], halves)
                for me, q, low, high in zip(own_ids[at:at + 256], queries[at:at + 256], lows, highs, strict=True):
                    length = math.sqrt(float(q @ q))
                    # row by row: equal vectors score alike, whichever others are verified with them
                    # |x' - q'|^2 = 2 * longest^2 - 2 * (q . x) * longest / |q|
                    distance = lambda s, c=longest / length: np.sqrt(np.maximum(2 * longest ** 2 - 2 * c * s, 0.0))
                    rows, scores, ended = found.search(low, high, halves, k + 1, lambda r, q=q: np.einsum("ij,j->i", index[r], q), distance, threshold, enough, max(ended - 1, 0))
                    keep = (ids[rows] != me) | missing[rows]
                    rows, scores = rows[keep], scores[keep]
                    best = np.lexsort((ids[rows], -scores))[:k]
                    out.append((np.full(len(best), me), ids[rows[best]], missing[rows[best]], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64(), mask=columns[2]), "score": pa.array(columns[3], pa.float64())})

    def dealt(rows: DataFrame, own: int, own_name: str, other: int, other_name: str) -> DataFrame:
        return rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(own)).cast("int").alias(own_name), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name))

    index = dealt(usable, index_blocks, "ib", query_blocks, "qb").groupBy("ib", "qb")
    queries = dealt(usable.where("query"), query_blocks, "qb", index_blocks, "ib").groupBy("ib", "qb")
    found = index.cogroup(queries).applyInArrow(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")

