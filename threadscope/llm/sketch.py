"""Cell counts: arrays of a fixed number of cells, filled per task, added up on the executors.

Their size doesn't depend on the data, so the sum may be brought to the driver and broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

CELL_BITS = 20
ID_BITS = 22
SLICES = 32
CELLS = "slice int, cells binary"


def packed(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Non-empty slices of a cell count array, packed."""
    parts = [(i, p) for i, p in enumerate(np.split(counts, SLICES)) if p.any()]
    return [i for i, _ in parts], [zlib.compress(p.astype("<u4").tobytes(), 1) for _, p in parts]


def add_up(rows: DataFrame, size: int = 1 << CELL_BITS) -> np.ndarray:
    """The sum of all tasks' (slice, cells): added up by slice on the executors, ``size`` cells arrive here."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cells in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist()):
                got = np.frombuffer(zlib.decompress(cells), "<u4").astype(np.int64)
                sums[i] = sums[i] + got if i in sums else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())],
            names=["slice", "cells"])

    total = np.zeros(size, np.int64)
    step = size // SLICES
    for r in arrow_map(rows.select("slice", "cells").repartition(SLICES, "slice"), run, CELLS).collect():
        total[r["slice"] * step:(r["slice"] + 1) * step] += np.frombuffer(zlib.decompress(r["cells"]), np.int64)
    return total


def _spread(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def seen_in(ids: DataFrame, col: str) -> np.ndarray:
    """A bit per cell of an id space: whether an id of ``col`` may be among ``ids`` (no false 'no')."""

    def run(batches):
        counts = np.zeros(1 << ID_BITS, np.uint8)
        for batch in batches:
            counts[_spread(batch.column(0).to_numpy(zero_copy_only=False))] = 1
        at, cells = packed(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(cells, pa.binary())], names=["slice", "cells"])

    return add_up(arrow_map(ids.select(col), run, CELLS), 1 << ID_BITS) > 0


def may_be_in(batch: pa.RecordBatch, seen: np.ndarray, wanted: bool) -> pa.RecordBatch:
    """The rows of a batch whose id's cell is set (or isn't); null ids go either way."""
    ids = batch.column("doc_id")
    keep = seen[_spread(ids.fill_null(0).to_numpy(zero_copy_only=False))] == wanted
    return batch.filter(pa.array(keep & ~np.asarray(ids.is_null())))


def maybe_in(texts: DataFrame, seen, wanted: bool) -> DataFrame:
    """The rows (doc_id, text) whose id's cell is set (or isn't)."""

    def run(batches):
        for batch in batches:
            yield may_be_in(batch, seen.value, wanted)

    return arrow_map(texts, run, "doc_id long, text binary")
