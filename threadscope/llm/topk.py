"""Exact top-k inner-product search: ball-tree branch and bound per shard.

Each shard (partition) of the candidates builds a ball tree. A node with centre c and radius r holds
no score above ``q.c + |q| r`` for query q, so it is skipped once that bound is below the k-th best
score q has. Every query visits a node's children in the order of its own bounds. The k-th scores
are shared: a first pass over one bounded piece of candidates gives every query a k-th score that
all shards start from, and inside a shard each leaf raises it for the next.

Queries are dealt in blocks of bounded size, each searched against all candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

LEAF = 128


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: ``floor(scale * x)`` of every component; rows without id, vector, a component or a
    finite component take no part."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


class _Tree:
    """Nodes as arrays over a reordering of the points; node i has children ``kids[i]`` or is a leaf."""

    def __init__(self, points: np.ndarray):
        self.order, self.spans, self.kids, self.centre, self.radius = np.arange(len(points)), [], [], [], []
        self._grow(points, 0, len(points))

    def _grow(self, points: np.ndarray, lo: int, hi: int) -> int:
        rows = points[self.order[lo:hi]]
        centre = rows.mean(0)
        away = np.sqrt(((rows - centre) ** 2).sum(1))
        me = len(self.spans)
        self.spans.append((lo, hi))
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.kids.append(None)
        if hi - lo > LEAF and self.radius[me] > 0:
            far = rows[int(away.argmax())]
            other = rows[int(((rows - far) ** 2).sum(1).argmax())]
            side = rows @ (other - far)
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(side, mid)]
            self.kids[me] = (self._grow(points, lo, lo + mid), self._grow(points, lo + mid, hi))
        return me


class _Best:
    """The k best (score, -id) of every query so far."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor.copy()
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        score = np.where(vec[None, :] == self.ids[q][:, None], -np.inf, score)
        s = np.concatenate((self.score[q], score), 1)
        v = np.concatenate((self.vec[q], np.broadcast_to(vec, score.shape)), 1)
        v = np.where(np.isneginf(s), np.iinfo(np.int64).max, v)
        best = np.lexsort((v, -s), axis=1)[:, :self.k]
        self.score[q], self.vec[q] = np.take_along_axis(s, best, 1), np.take_along_axis(v, best, 1)
        self.floor[q] = np.maximum(self.floor[q], self.score[q, -1])


def _search(queries: np.ndarray, norms: np.ndarray, points: np.ndarray, vec: np.ndarray, best: _Best) -> None:
    tree = _Tree(points)
    centre, radius = np.array(tree.centre), np.array(tree.radius)
    bounds = queries @ centre.T + norms[:, None] * radius
    bounds += 1e-9 * np.abs(bounds) + 1e-6  # the sums above are rounded; scores are whole

    def visit(node: int, q: np.ndarray) -> None:
        q = q[bounds[q, node] >= best.floor[q]]
        if not len(q):
            return
        if tree.kids[node] is None:
            rows = tree.order[slice(*tree.spans[node])]
            scores = queries[q] @ points[rows].T
            hit = (scores >= best.floor[q][:, None]).any(1)
            if hit.any():
                best.add(q[hit], scores[hit], vec[rows])
            return
        a, b = tree.kids[node]
        first = bounds[q, a] >= bounds[q, b]
        for one, two, some in ((a, b, q[first]), (b, a, q[~first])):
            visit(one, some)
            visit(two, some)

    visit(0, np.arange(len(queries)))


def _vectors(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of each vector length in a batch."""
    column = batch.column("v")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    ids, flat = batch.column("vec_id").to_numpy(), column.flatten().to_numpy().astype(np.float64)
    begins = np.cumsum(sizes) - sizes
    return [(ids[sizes == n], flat[begins[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)]


_FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, shard_rows: int = 20_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` best candidates in ``vectors``.

    Both frames come from :func:`quantized`. A query's own row (any row of the same id) is no
    candidate; of several query rows with one id the smallest vector is used; repeated candidates
    count each. Ties go to the smaller id. Only vectors of the query's length are compared. Scores
    are exact while they fit 53 bits. With fewer than k candidates all are returned; empty tables
    give no rows. ``block`` queries are sent to the shards at a time, whatever their number.
    """
    spark = vectors.sparkSession
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    placed = one.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-max(one.count(), 1) // block))))
    n = vectors.count()
    shards = vectors.repartition(max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // 2000)), "vec_id")
    out = None
    for at in [r[0] for r in placed.select("block").distinct().collect()]:
        rows = placed.where(F.col("block") == at).orderBy("vec_id").toArrow().select(["vec_id", "v"])
        blocks = {}
        for batch in rows.to_batches():
            for ids, q in _vectors(batch):
                blocks.setdefault(q.shape[1], []).append((ids, q))
        blocks = {d: (np.concatenate([i for i, _ in x]), np.concatenate([q for _, q in x])) for d, x in blocks.items()}
        floors = {d: np.full(len(ids), -np.inf) for d, (ids, _) in blocks.items()}
        first = vectors.limit(shard_rows).toArrow()  # a bounded piece; it only sets where the search starts
        for batch in first.to_batches():
            for ids, points in _vectors(batch):
                if points.shape[1] in blocks:
                    qi, q = blocks[points.shape[1]]
                    best = _Best(qi, k, floors[points.shape[1]])
                    _search(q, np.sqrt((q * q).sum(1)), points, ids, best)
                    floors[points.shape[1]] = np.maximum(floors[points.shape[1]], best.floor)
        found = arrow_map(shards, _searcher(spark.sparkContext.broadcast((blocks, floors)), k), _FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _searcher(sent, k: int):
    def run(batches):
        blocks, floors = sent.value
        best = {d: _Best(ids, k, floors[d]) for d, (ids, _) in blocks.items()}
        for batch in batches:
            for ids, points in _vectors(batch):
                if points.shape[1] in blocks:
                    q = blocks[points.shape[1]][1]
                    _search(q, np.sqrt((q * q).sum(1)), points, ids, best[points.shape[1]])
        for d, b in best.items():
            q, j = np.nonzero(b.vec != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids[q]), pa.array(b.vec[q, j]), pa.array(b.score[q, j].astype(np.int64))],
                names=["query_id", "vec_id", "score"])

    return run
