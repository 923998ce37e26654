"""PCA whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers x = floor(64 c) + 1000000. The fit list holds each distinct x once: n rows with
sums S per dimension, so a centred entry is the exact integer n*x - S over n. With X the centred rows,
the bidiagonalisation builds orthonormal V (dimensions) and U (rows) with X V = U B and B upper
bidiagonal (in blocks of ``block`` columns: a pass over the rows serves a whole block). Each step is one
distributed pass: tasks take a block of rows, form Xv for the step's vectors and for all earlier ones,
and sum Xᵀu and the inner products that orthogonalise u against all earlier u. No u is stored: every u
is X w for a small w, which the recurrence gives. v is orthogonalised against all earlier v, twice.
The singular values of B are sqrt(n) times the deviations of the components, the right vectors give
the components. Steps go on until the leading components' residuals are at rounding level, at the
latest until V spans all dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, saved

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK = 8
#: Entries with a larger size than this count as not finite: no exact sums are possible beyond.
LARGEST = 2.0 ** 40
_ROWS = 4096


def quantized(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (i64 LE bytes), dims of every row whose vector is not null, not empty and holds only finite entries."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v")):
                c = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0)
                if len(c) and not v.values.null_count and (np.abs(c) < LARGEST).all():
                    ids.append(i)
                    out.append((np.floor(SCALE * c).astype(np.int64) + SHIFT).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array([len(x) // 8 for x in out], pa.int32())],
                                             names=["vec_id", "x", "dims"])

    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return arrow_map(rows, run, "vec_id long, x binary, dims int")


def _matrix(column, begin: int, stop: int) -> np.ndarray:
    """Rows of equal vectors' bytes as an integer matrix."""
    part = column.slice(begin, stop - begin).to_pylist()
    return np.frombuffer(b"".join(part), np.int64).reshape(len(part), -1)


def scaled(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - S: exact, in 64 bits where they hold it, else in whole numbers of any size."""
    if n * float(np.abs(x).max(initial=0)) + float(max(abs(int(v)) for v in s)) < 2.0 ** 62:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S/n, each entry one rounding away from its value."""
    return scaled(x, n, s).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int]:
    """The sum over dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
    d = scaled(x, n, s)
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0 ** 62:
        return (d * d).sum(1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in sums]


class _Rows:
    """The fit list: distributed products with its centred rows."""

    def __init__(self, rows: DataFrame):
        self.rows, self.spark = rows, rows.sparkSession
        first = rows.select("dims").first()
        self.dims = first[0] if first else 0
        self.n, self.s = 0, np.zeros(self.dims, object)
        if self.dims:
            def run(batches):
                n, s = 0, None
                for batch in batches:
                    for at in range(0, batch.num_rows, _ROWS):
                        x = _matrix(batch.column("x"), at, min(at + _ROWS, batch.num_rows))
                        s = x.sum(0) + (0 if s is None else s)
                        n += len(x)
                values = [n, *(s.tolist() if n else [])]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.int64())], names=["at", "value"])

            got = dict(arrow_map(rows.select("x"), run, "at int, value long").groupBy("at").agg(
                F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
            self.n = int(got[0])
            self.s = np.array([int(got[i + 1]) for i in range(self.dims)], object)

    def sums(self, small: tuple[np.ndarray, ...], measure) -> np.ndarray:
        """The sum over all blocks of rows of ``measure(centred rows, *small)``, an array each. Tasks add up their
        blocks; Spark adds the tasks' numbers, entry by entry, so the driver gets one array."""
        sent = self.spark.sparkContext.broadcast((self.n, self.s, small))

        def run(batches):
            n, s, small = sent.value
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    x = centred(_matrix(batch.column("x"), at, min(at + _ROWS, batch.num_rows)), n, s)
                    part = measure(x, *small)
                    total = part if total is None else total + part
            flat = np.empty(0) if total is None else total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "value"])

        got = arrow_map(self.rows.select("x"), run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        sent.destroy()
        out = np.zeros(len(got))
        out[got["at"].to_numpy()] = got["value"].to_numpy()
        return out


def _orthogonal(y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``y`` without its part in the span of ``v``."""
    for _ in range(2):
        y = y - v @ (v.T @ y)
    return y


def _basis(y: np.ndarray, v: np.ndarray, width: int, small: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal block q (up to ``width`` columns) orthogonal to ``v``, and b with y = q b. Directions in which
    ``y`` is no longer than ``small`` are replaced by random ones (zero rows of b), so that the search goes on."""
    p, size, qt = np.linalg.svd(y, full_matrices=False)
    keep = size > small
    q, b = p[:, keep], size[keep, None] * qt[keep]
    while q.shape[1] < min(width, len(v) - v.shape[1]):
        more = _orthogonal(rng.standard_normal((len(v), 1)), np.hstack((v, q)))
        q = np.hstack((q, more / np.linalg.norm(more)))
        b = np.vstack((b, np.zeros((1, b.shape[1]))))
    q = _orthogonal(q, v)
    q, r = np.linalg.qr(q)  # rounding of a nearly orthonormal block
    return q, r @ b


def _step(x: np.ndarray, w: np.ndarray, old: np.ndarray) -> np.ndarray:
    u = x @ w  # Xv of this step
    return np.vstack((x.T @ u, (x @ old).T @ u, u.T @ u))  # Xᵀu, and the products with earlier u and itself


def bidiagonalise(rows: _Rows, components: int = COMPONENTS, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit components (columns, by falling deviation), their eigenvalues of the covariance, and its trace."""
    d, n = rows.dims, rows.n
    rng = np.random.default_rng(seed)
    trace = float(rows.sums((), lambda x: np.array([(x * x).sum()]))[0])
    if not trace:
        return np.zeros((d, 0)), np.zeros(0), 0.0
    tiny = np.finfo(float).eps * np.sqrt(trace)  # of Xv; X's Frobenius norm is sqrt(trace)
    v = np.linalg.qr(rng.standard_normal((d, min(block, d))))[0]
    w, z, b = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, v.shape[1]))
    last, above = slice(0, v.shape[1]), np.zeros((0, v.shape[1]))  # the step's columns of v; the block of b above them
    w_last = np.zeros((d, 0))
    while True:
        vk = v[:, last]
        wk = vk - w_last @ above  # u = X wk, less the part that the step before accounts for
        got = rows.sums((wk, w), _step).reshape(-1, wk.shape[1])
        zk, c, g = got[:d], got[d:d + w.shape[1]], got[d + w.shape[1]:]
        wk, zk, g = wk - w @ c, zk - z @ c, g - c.T @ c
        size, q = np.linalg.eigh((g + g.T) / 2)
        keep = size > tiny ** 2 * d
        root = np.sqrt(size[keep])
        wk, zk, a = wk @ q[:, keep] / root, zk @ q[:, keep] / root, root[:, None] * q[:, keep].T
        # b grows by the row block of this step's u: (a) below what the v block had from earlier u
        b[:, last] += c
        b = np.vstack((b, np.hstack((np.zeros((len(a), last.start)), a))))
        w, z, w_last = np.hstack((w, wk)), np.hstack((z, zk)), wk
        if v.shape[1] == d:
            break
        new, up = _basis(_orthogonal(zk - vk @ a.T, v), v, vk.shape[1], tiny, rng)
        p, sigma, _ = np.linalg.svd(b, full_matrices=False)
        # residual of component i: what Xᵀu_i has outside V
        residual = np.linalg.norm(up @ p[len(b) - len(a):, :components], axis=0) if len(a) else np.zeros(0)
        if len(sigma) >= components and v.shape[1] >= 2 * block and (residual <= 4 * np.finfo(float).eps * sigma[0]).all() and len(residual):
            break
        above = up.T
        last = slice(v.shape[1], v.shape[1] + new.shape[1])
        v = np.hstack((v, new))
        b = np.hstack((b, np.vstack((np.zeros((len(b) - len(a), new.shape[1])), above))))
    _, sigma, qt = np.linalg.svd(b, full_matrices=False)
    keep = sigma ** 2 > d * np.finfo(float).eps * sigma[0] ** 2  # the rank of the covariance in double precision
    sigma, vectors = sigma[keep][:components], (v @ qt.T)[:, keep.nonzero()[0][:components]]
    return vectors / np.linalg.norm(vectors, axis=0), sigma ** 2 / n, trace / n


def whiten(embeddings: DataFrame, components: int = COMPONENTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row with a finite vector.

    Rows whose vector is null, empty, or holds null or non-finite entries (or ones beyond 2^40) are left
    out; so are those of another dimension than most distinct vectors (of equals, the larger). Repeated
    rows and rows without id are all returned. Directions without variance (below the rounding of the
    covariance) give no component: one distinct vector, or an empty table, gives no rows. ``deviation`` is null where it exceeds a long.
    """
    spark = embeddings.sparkSession
    rows = saved(quantized(embeddings, id_col, vector_col), "whitening-rows")
    fit = saved(rows.groupBy("x").agg(F.first("dims").alias("dims")), "whitening-fit")
    usual = fit.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = usual["dims"] if usual else 0
    rows, fit = rows.where(F.col("dims") == dims), _Rows(fit.where(F.col("dims") == dims))
    vectors, e, trace = bidiagonalise(fit, components, block) if fit.n > 1 else (np.zeros((dims, 0)), np.zeros(0), 0.0)
    k = len(e)
    project = vectors / np.sqrt(e)
    error = 0.0
    if k:
        got = fit.sums((project,), lambda x, p: np.vstack(((x @ p).T @ (x @ p), (x @ p).sum(0)))).reshape(k + 1, k) / fit.n
        error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    sent = spark.sparkContext.broadcast((fit.n, fit.s, project, e / trace if k else e, error))

    def run(batches):
        n, s, project, explained, error = sent.value
        k = len(explained)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS if k else batch.num_rows):
                if not k:
                    break
                stop = min(at + _ROWS, batch.num_rows)
                x = _matrix(batch.column("x"), at, stop)
                m = stop - at
                row = pa.array(np.repeat(np.arange(at, stop), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array(deviations(x, n, s), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array((centred(x, n, s) @ project).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return arrow_map(rows.select("vec_id", "x"), run, "vec_id long, component int, n long, deviation long, whitened double, "
                                                      "explained double, identity_error double")
