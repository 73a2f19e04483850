"""Exact top-k by inner product without random access.

Candidates are dealt into blocks. A block keeps one sorted list per component. A query reads its
lists from the end that adds most, the same depth in each, and knows for every candidate a lower
and an upper bound of its score: what was read, plus the least or the most that the unread part of
each other list can add. The depth doubles, at most to half of a list, and candidates whose upper
bound is below the k-th lower bound are out; reading stops early when few are left. The final
scores of the others are resolved. Nobody that could qualify is left out, ties included, so results
are exact. Bounds of all queries of a block come from the same matrix products.

Components are turned into floor(scale * x) first. Vectors that are null or hold a null or
non-finite component take no part, neither do vectors of another length meet. Empty vectors score
0 with each other. Repeated ids are candidates row by row, but an id never meets its own. Scores
are exact integers below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Candidates and queries that meet in one task at most (on average; dealt by hash).
CANDIDATES, QUERIES = 4096, 512


class SortedLists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        n, dims = vectors.shape
        by_value = np.argsort(self.vectors, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.vectors, by_value, axis=0)
        self.place = np.empty((n, dims), dtype=np.int32)  # where each candidate stands in each list
        np.put_along_axis(self.place, by_value, np.arange(n, dtype=np.int32)[:, None], axis=0)

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores after ``depth`` entries of each list.

        ``up`` has the positive query components (their lists are read from the top), ``down`` the
        negative ones (read from the bottom). Rows are candidates, columns queries.
        """
        n = len(self.ids)
        top, bottom = (self.place >= n - depth).astype(float), (self.place < depth).astype(float)
        known = (self.vectors * top) @ up + (self.vectors * bottom) @ down

        def unread(high: np.ndarray, low: np.ndarray) -> np.ndarray:
            a, b = up * high[:, None], down * low[:, None]
            return (a + b).sum(0) - top @ a - bottom @ b

        lower = known + unread(self.lists[0], self.lists[-1])
        return lower, known + unread(self.lists[n - depth], self.lists[depth - 1])

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and scores of the k best other rows, ties to the smaller id."""
        n, asked = len(self.ids), queries.T.astype(np.float64)
        up, down = np.maximum(asked, 0), np.minimum(asked, 0)
        alive = self.ids[:, None] != query_ids[None, :]
        reading, depth = np.arange(len(query_ids)), max(1, n // 8)
        while depth < n and n > 8 * k and len(reading):
            lower, upper = self.bounds(up[:, reading], down[:, reading], depth)
            lower[~alive[:, reading]] = -np.inf
            worst = np.partition(lower, n - k, axis=0)[n - k]
            alive[:, reading] &= upper >= worst
            reading = reading[alive[:, reading].sum(0) > 4 * k]
            depth *= 2
        result = []
        whole = self.vectors @ asked if alive.sum() > n else None
        for j in range(len(query_ids)):
            left = np.flatnonzero(alive[:, j])
            scores = whole[left, j] if whole is not None else self.vectors[left] @ asked[:, j]
            if len(left) > k:
                best = scores >= np.partition(scores, len(left) - k)[len(left) - k]
                left, scores = left[best], scores[best]
            order = np.lexsort((self.ids[left], -scores))[:k]
            result.append((self.ids[left][order], scores[order].astype(np.int64)))
        return result


def quantised(column: str | Column, scale: int = 1024) -> Column:
    """floor(scale * x) per component; null where the vector takes no part."""
    c = F.col(column) if isinstance(column, str) else column
    doubles = F.transform(c, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(doubles, lambda x: F.floor(x * scale).cast("bigint")))


def _matrix(t: pa.Table, dims: int) -> np.ndarray:
    values = t.column("vector").combine_chunks()
    flat = values.flatten() if isinstance(values, pa.ListArray) else pa.concat_arrays([c.flatten() for c in values.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, dims)


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 10, candidate_rows: int = CANDIDATES, query_rows: int = QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score.

    Both inputs have (vec_id bigint, vector array<bigint>). Each pair of a block of queries and a
    block of candidates meets in one task, which passes on k rows a query; the rest is a ranking
    of those. Block counts follow from the row counts, so tasks stay the same size. Equal query rows
    count once; query rows of one id with different vectors are ranked each for itself.
    """
    queries = queries.select("vec_id", "vector").distinct()
    n, q = candidates.count(), queries.count()
    n_blocks, q_blocks = max(1, -(-n // candidate_rows)), max(1, -(-q // query_rows))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    everywhere = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = candidates.select(deal(n_blocks).alias("c"), everywhere(q_blocks).alias("q"), F.size("vector").alias("dims"), "vec_id", "vector")
    right = queries.select(everywhere(n_blocks).alias("c"), deal(q_blocks).alias("q"), F.size("vector").alias("dims"), "vec_id", "vector", F.xxhash64("vector").alias("asked"))

    def meet(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        query_id, same, vec_id, score = [], [], [], []
        if rows.num_rows and asked.num_rows:
            dims = key[2].as_py()
            lists = SortedLists(rows.column("vec_id").to_numpy(), _matrix(rows, dims))
            own_ids, vectors = asked.column("vec_id").to_numpy(), asked.column("asked").to_numpy()
            for own, vector, (ids, scores) in zip(own_ids, vectors, lists.top(own_ids, _matrix(asked, dims), k)):
                query_id.append(np.full(len(ids), own))
                same.append(np.full(len(ids), vector))
                vec_id.append(ids)
                score.append(scores)
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, dtype=np.int64), type=pa.int64()) for c in (query_id, same, vec_id, score)]
        return pa.table(columns, names=["query_id", "asked", "vec_id", "score"])

    found = left.groupBy("c", "q", "dims").cogroup(right.groupBy("c", "q", "dims")).applyInArrow(
        meet, "query_id bigint, asked bigint, vec_id bigint, score bigint"
    )
    order = F.row_number().over(W.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
