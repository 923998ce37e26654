import math
import random

import numpy as np

from threadscope.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v int, score long, query_id int"


def brute(rows, queries, k=5):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i in queries}):
        mine = min(v for i, v in fine if i == q)
        scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in fine if i != q and len(v) == len(mine))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def run(spark, rows, queries, **options):
    df = topk.quantized(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5))
    got = topk.top_k(df, df.where(df.vec_id.isin(sorted(queries))), **options).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def test_clusters_ties_and_copies(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 8]]) for i in range(3000)]
    rows += [(5000 + i, rows[i % 3][1]) for i in range(300)]  # many equal scores
    queries = {*range(0, 3000, 50), 5000, 5299}
    assert run(spark, rows, queries) == brute(rows, queries)


def test_query_blocks_and_shards(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(600)]
    queries = set(range(0, 600, 10))
    assert run(spark, rows, queries, block=7, shard_rows=50) == brute(rows, queries)


def test_hostile_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (None, [9.0, 9.0]), (7, [1.0, 2.0, 3.0]), (50, [-0.001, 0.5]), (50, [0.5, 0.5]), (100, [3.0, 3.0, 3.0, 3.0]), (150, None)]
    assert run(spark, rows, {0, 50, 100, 150}) == brute(rows, {0, 50, 100, 150})


def test_empty_tables(spark):
    df = topk.quantized(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(df, df).count() == 0
    one = topk.quantized(spark.createDataFrame([(0, [1.0], 1, 2, 3, 4)], SCHEMA))
    assert topk.top_k(one, one).count() == 0


def test_tree_skips_nodes():
    """The bound lets whole subtrees go: far fewer than all leaves are scored."""
    rng = np.random.default_rng(1)
    points = np.floor(256 * (rng.normal(0, 0.05, (8000, 8)) + 3 * np.eye(8)[rng.integers(0, 8, 8000)]))
    ids = np.arange(8000)
    best = topk._Best(np.arange(1), 5, np.full(1, -np.inf))
    scored = []
    add = best.add
    best.add = lambda q, s, v: (scored.append(len(v)), add(q, s, v))
    q = points[:1]
    topk._search(q, np.sqrt((q * q).sum(1)), points, ids, best)
    assert sum(scored) < 4000
    s = points @ q[0]
    s[0] = -np.inf
    assert best.vec[0].tolist() == np.lexsort((ids, -s))[:5].tolist()
