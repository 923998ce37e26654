"""Connected components of a link table: local union, then alternating large-star and small-star rounds.

Links are read in parts of at most about ``PART`` rows. Each part is united by itself, in memory bounded
by its size, into links to the smallest node it knows; more machines take more parts. What different
parts say about a node then meets in one groupBy: if no node hears of two nodes smaller than itself and
its root of none, the links are stars and done (always so where all links fit one part). Otherwise a
large-star and a small-star round move links to smaller nodes and the parts begin again. The number of
links never grows. All shuffled work is groupBy(min) and equi-joins on (long, long) rows, so a node with
very many links is pre-aggregated before its shuffle, and the join that hands its minimum back can be
split by adaptive execution.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_saved, saved

#: Links that one task unites at a time (16 bytes each, about ten times that while it works).
PART = 1 << 18


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) that are not the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _unite(part: int):
    def run(batches):
        held, size = [], 0

        def out():
            u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in united(u, v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * part:  # files of uneven size: what one task holds stays bounded
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _large(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v), u > v; least: node, component. Every larger neighbour of a node moves to the node's smallest."""
    return links.join(least, F.col("v") == F.col("node")).select("u", F.col("component").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, move to u's smallest."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", part: int = PART) -> DataFrame:
    """node, component (its smallest node) of every node with a link to another; loops, repeated and
    null links add nothing."""
    now = saved(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    while True:
        parts = max(1, -(-now.count() // part))
        forest = saved(arrow_map(now.coalesce(parts), _unite(part), "u long, v long"), "links")
        drop_saved(now)
        heard = forest.select(F.col("u").alias("node"), "v").unionByName(forest.select(F.col("v").alias("node"), "v"))
        known = saved(heard.groupBy("node").agg(F.min("v").alias("component"), F.max("v").alias("other")), "components")
        if known.where("component < other").isEmpty():
            drop_saved(forest)
            return known.select("node", "component")
        now = saved(_small(_large(forest.distinct(), known.select("node", "component"))), "links")
        drop_saved(forest)
        drop_saved(known)
