import math

import numpy as np
import pytest

from threadscope.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x long, dims int, n long, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


def fine(rows):
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in kept]


def check(got, rows, components=16, at_least=None):
    """Against the eigenvectors of the covariance from whole numbers."""
    rows = fine(rows)
    x = sorted({v for _, v in rows})
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x])
    e, vectors = np.linalg.eigh(d.T @ d / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(components, int((e > len(e) * 2.3e-16 * e[0]).sum()))
    by_row = {}
    for r in got:
        by_row.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], r["whitened"]))
        assert r["n"] == n and r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-6)
        assert r["identity_error"] < 1e-8
    assert sorted(by_row) == list(range(1, k + 1))
    key = lambda r: (str(r[0]), r[1], r[2])
    for c, found in by_row.items():
        assert len(found) == len(rows)
        gaps = [abs(e[c - 1] - e[j]) for j in range(len(e)) if j != c - 1]
        if min(gaps, default=1) < 1e-6 * e[0]:
            continue  # equal eigenvalues: any basis of their plane will do
        wanted = [(i, sum((n * a - b) ** 2 for a, b in zip(v, s)), float(np.array([(n * a - b) / n for a, b in zip(v, s)]) @ vectors[:, c - 1] / math.sqrt(e[c - 1])))
                  for i, v in rows]
        flipped = [(i, dev, -w) for i, dev, w in wanted]
        same = lambda a, b: all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 for x, y in zip(sorted(a, key=key), sorted(b, key=key)))
        assert same(found, wanted) or same(found, flipped)


def test_clusters_with_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.3, 24)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # a third are copies; they count once in the fit
    check(W.whiten(table(spark, rows).repartition(5)).collect(), rows)


def test_hostile_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (None, [-9.0, 4.5]), (8, [0.0, -0.001])]
    check(W.whiten(table(spark, rows)).collect(), rows)
    other = rows + [(7, [1.0, 2.0, 3.0])]  # one vector of another dimension
    check(W.whiten(table(spark, other)).collect(), rows)


def test_directions_without_variance(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.repeat(rng.normal(0, 5, 4), 5).tolist()) for i in range(60)]
    got = W.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}
    check(got, rows)
    assert W.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0


def test_empty_table(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, None)])).count() == 0


class Local(W._Rows):
    def __init__(self, x):
        self.x, (self.n, self.dims), self.s = x, x.shape, x.sum(0).astype(object)
        self.passes = 0

    def sums(self, small, measure):
        self.passes += 1
        return measure(W.centred(self.x, self.n, self.s), *small).ravel()


@pytest.mark.parametrize("block", [1, 3, 8])
def test_bidiagonalisation_equals_eigenvectors(block):
    rng = np.random.default_rng(3)
    shapes = [rng.normal(0, 1, (400, 40)), rng.normal(0, 1, (400, 40)) * np.exp(-np.arange(40) / 4), np.vstack((np.eye(30), -np.eye(30))), rng.normal(0, 1, (9, 30))]
    for m in shapes:
        x = np.floor(640 * m).astype(np.int64) + 1_000_000
        c = W.centred(x, len(x), x.sum(0).astype(object))
        cov = c.T @ c / len(x)
        wanted = np.linalg.eigvalsh(cov)[::-1]
        vectors, e, trace = W.bidiagonalise(Local(x), block=block)
        assert len(e) == min(16, int((wanted > 1e-14 * wanted[0]).sum()))
        assert np.allclose(e, wanted[:len(e)], rtol=1e-10) and trace == pytest.approx(np.trace(cov), rel=1e-12)
        assert np.abs(cov @ vectors - vectors * e).max() < 1e-12 * e[0] and np.allclose(vectors.T @ vectors, np.eye(len(e)), atol=1e-12)


def test_steps_end_before_all_dimensions():
    rng = np.random.default_rng(4)
    rows = Local(np.floor(64 * rng.normal(0, 1, (2000, 400)) * 30 / (1 + np.arange(400.0))).astype(np.int64) + 1_000_000)
    W.bidiagonalise(rows)
    assert rows.passes < 20


def test_whole_numbers_of_any_size():
    x = np.array([[2 ** 45, 1], [0, 3]])
    s = np.array([2 ** 60, 7], object)
    assert W.scaled(x, 1 << 20, s).tolist() == [[2 ** 65 - 2 ** 60, 2 ** 20 - 7], [-(2 ** 60), 3 * 2 ** 20 - 7]]
    assert W.deviations(x, 1 << 20, s) == [None, None]
    assert W.deviations(np.array([[2, 5]]), 3, np.array([4, 5], object)) == [2 ** 2 + 10 ** 2]
