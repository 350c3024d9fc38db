"""Exact top-k inner products by ball-tree branch and bound.

Vectors are quantised to whole numbers, so scores are exact. Queries are taken in blocks of bounded size: a
block is broadcast, every task builds ball trees over its own vectors, shard by shard, and searches them for
the whole block. A node's ball bounds the inner product of any vector in it by q.c + |q| r (and by its parent's
bound); a query visits its leaves in descending order of that bound and stops at the first below its current
k-th score. The k-th score is carried from shard to shard of a task, and before the first shard it is the k-th
score among the block's own queries, which are rows of the table too. Tasks send k rows a query to the merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

TOP = 5
SCALE = 256
#: Queries of one block, and so of one broadcast: a bound on memory, not on queries.
BLOCK = 16_384
#: Vectors of one tree, and of one leaf.
SHARD = 8_192
LEAF = 64
_LOW = np.iinfo(np.int64).min


class BallTree:
    """Points halved along their widest axis until a node has LEAF of them; nodes by level, the children of i at 2i and 2i + 1."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        bounds, self.levels = [(0, len(points))], []
        x = points.astype(np.float64)
        while True:
            centre = np.stack([x[self.order[a:b]].mean(axis=0) if b > a else np.zeros(x.shape[1]) for a, b in bounds])
            # the radius is rounded up, so the bound holds in floating point
            radius = np.array([np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(axis=1).max()) * (1 + 1e-9) + 1e-9 if b > a else -1.0 for (a, b), c in zip(bounds, centre, strict=True)])
            self.levels.append((centre, radius))
            if max(b - a for a, b in bounds) <= leaf:
                break
            halves = []
            for a, b in bounds:
                own = self.order[a:b]
                m = (a + b) // 2
                if b - a > 1:
                    axis = int(np.argmax(np.ptp(x[own], axis=0)))
                    self.order[a:b] = own[np.argsort(x[own, axis], kind="stable")]
                halves += [(a, m), (m, b)]
            bounds = halves
        self.leaves = bounds

    def bounds(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Upper bound of each query (rows) in each leaf; -inf where an ancestor's bound is below the query's floor."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q**2).sum(axis=1))
        out = np.full((len(q), len(self.leaves)), -np.inf)
        # a node is only multiplied for the queries that its parent's bound let through
        open_ = {0: (np.arange(len(q)), np.full(len(q), np.inf))}
        for depth, (centre, radius) in enumerate(self.levels):
            below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for node, (rows, parent) in open_.items():
                if radius[node] < 0:
                    continue
                ub = q[rows] @ centre[node] + norm[rows] * radius[node]
                ub = np.minimum(ub + np.abs(ub) * 1e-9 + 1e-6, parent)
                ok = ub >= floor[rows]
                rows, ub = rows[ok], ub[ok]
                if depth == len(self.levels) - 1:
                    out[rows, node] = ub
                elif len(rows):
                    below[2 * node] = below[2 * node + 1] = (rows, ub)
            open_ = below
        return out


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), _LOW, dtype=np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.floor = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], np.where(score == _LOW, np.iinfo(np.int64).max, np.broadcast_to(ids, score.shape))], axis=1)
        order = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s != _LOW], dtype=np.float64).max(initial=0) < 2**53 else ~s), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
        last = self.score[rows, -1]
        self.floor[rows] = np.maximum(self.floor[rows], np.where(last == _LOW, -np.inf, last))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where every partial sum fits its 53 bits, else by whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search(best: Best, ids: np.ndarray, queries: np.ndarray, shard_ids: np.ndarray, shard: np.ndarray) -> None:
    """Updates best with one shard."""
    tree = BallTree(shard)
    ub = tree.bounds(queries, best.floor)
    turn = np.argsort(-ub, axis=1, kind="stable")
    sorted_ub = np.take_along_axis(ub, turn, axis=1)
    alive = np.arange(len(queries))
    for step in range(ub.shape[1]):
        alive = alive[(sorted_ub[alive, step] >= best.floor[alive]) & (sorted_ub[alive, step] > -np.inf)]
        if not len(alive):
            return
        leaf = turn[alive, step]
        by = np.argsort(leaf, kind="stable")
        for rows in np.split(alive[by], np.flatnonzero(np.diff(leaf[by])) + 1):
            a, b = tree.leaves[int(turn[rows[0], step])]
            own = tree.order[a:b]
            score = products(queries[rows], shard[own])
            score[ids[rows][:, None] == shard_ids[own][None, :]] = _LOW
            best.add(rows, score, shard_ids[own][None, :])


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): vectors as whole numbers; rows whose id or vector is null, empty, or has a null or non-finite component are left out."""
    # beyond 2**62 a component has no 64-bit score; 2**31 keeps 64-component sums inside 64 bits
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector), lambda x: fits(x.cast("double")))
    return df.where(good).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by inner product, ties to the smaller id.

    is_query: which rows are queries too. Rows of the query's own id are no candidates. A row with several
    copies of one id counts once for each; repeated rows keep their places. Vectors are compared with those of
    their own length only. Scores are exact in 64 bits for components below 2**28 at 64 dimensions. An empty
    table or no query gives an empty result.
    """
    spark = df.sparkSession
    rows = quantised(df, key, vector, scale)
    queries = quantised(df.where(is_query), key, vector, scale).distinct()
    n = queries.count()
    blocks = max(1, -(-n // block))
    queries = kept(queries.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "queries")
    schema = "query_id bigint, vec_id bigint, score bigint"
    found: DataFrame | None = None
    for b in range(blocks):
        own = queries.where(F.col("b") == b).select("id", "v").collect()  # about BLOCK rows
        by_dim: dict[int, tuple[list[int], list[list[int]]]] = {}
        for r in own:
            ids, vs = by_dim.setdefault(len(r[1]), ([], []))
            ids.append(r[0])
            vs.append(r[1])
        sent = spark.sparkContext.broadcast({d: (np.array(i, dtype=np.int64), np.array(v, dtype=np.int64)) for d, (i, v) in by_dim.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}
            held: dict[int, tuple[list, list]] = {}

            def floors(d: int) -> Best:
                """The k-th score among the block's own queries holds before the first shard."""
                ids, q = sent.value[d]
                out = Best(len(ids), k)
                for a in range(0, len(ids), 512):
                    at = np.arange(a, min(a + 512, len(ids)))
                    score = products(q[at], q)
                    score[ids[at][:, None] == ids[None, :]] = _LOW
                    if score.shape[1] >= k:
                        last = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                        out.floor[at] = np.where(last == _LOW, -np.inf, last)
                return out

            def flush(d: int) -> None:
                ids, vs = held.pop(d)
                if d in sent.value:
                    if d not in best:
                        best[d] = floors(d)
                    search(best[d], *sent.value[d], np.concatenate(ids), np.concatenate(vs))

            for batch in batches:
                ids, col = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                dims, flat = col.value_lengths().to_numpy(zero_copy_only=False), col.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(dims)
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    v = flat[(ends[at] - d)[:, None] + np.arange(d)[None, :]]
                    for a in range(0, len(at), shard):
                        own = held.setdefault(d, ([], []))
                        own[0].append(ids[at[a : a + shard]])
                        own[1].append(v[a : a + shard])
                        if sum(map(len, own[0])) >= shard:
                            flush(d)
            for d in list(held):
                flush(d)
            for d, x in best.items():
                q, c = np.nonzero(x.score != _LOW)
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][q]), pa.array(x.id[q, c]), pa.array(x.score[q, c])], names=["query_id", "vec_id", "score"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
