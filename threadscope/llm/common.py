"""Helpers shared by the training-data operators: tables, scratch space and vectorised word hashing.

Words are hashed with numpy straight from the UTF-8 bytes of an Arrow batch, 64 KiB at a time, so a
text of any length needs memory for its words only. A word's 64-bit hash depends on its bytes alone
(A-Z folded to a-z). Two given different words collide with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.session import scratch_path, ship_package

_PIECE = 1 << 16
_U = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the session's shared scratch folder and read back.

    This cuts the lineage like a reliable checkpoint, in compressed columnar form: lost executors
    re-read files instead of recomputing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Remove a table made by :func:`saved` once nothing reads it any more."""
    spark = df.sparkSession
    for part in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(part)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows per Arrow batch for jobs run inside, where rows are wide; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns needed, the text as UTF-8 bytes (null: empty)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, each made longer until it is new."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each row of a binary column, without copying."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for i in range(n):
        yield data[offsets[i]:offsets[i + 1]]


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWER = _powers(_BASE, _PIECE + 1)
_UNPOWER = _powers(_INVERSE, _PIECE + 1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _mixed(_LOWER.astype(np.uint64) * _U(0xD1342543DE82EF95) + _U(0x2545F4914F6CDD1D))

#: bytes of words ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_count(text: np.ndarray, keep: np.ndarray = SPACED) -> int:
    if not len(text):
        return 0
    inside = keep[text]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[0])


def word_hashes(text: np.ndarray, keep: np.ndarray = SPACED) -> np.ndarray:
    """The 64-bit hash of every word of the text, in order.

    Each byte adds ``value * base^position`` to a running sum; a word's hash is the difference of
    the sums at its ends, moved back to position 0 by the inverse power, then mixed.
    """
    starts, begun, ended = [], [], []
    carry, power, unpower, before = 0, 1, 1, False
    for at in range(0, len(text), _PIECE):
        piece = text[at:at + _PIECE]
        n = len(piece)
        inside = np.empty(n + 1, bool)
        inside[0] = before
        inside[1:] = keep[piece]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[piece] * _POWER[:n], out=sums[1:])
        first, last = edges[int(before)::2], edges[1 - int(before)::2]
        base = _U(carry)
        begun.append(base + sums[first] * _U(power))
        ended.append(base + sums[last] * _U(power))
        starts.append(_UNPOWER[first] * _U(unpower))
        before = bool(inside[-1])
        carry = (carry + int(sums[-1]) * power) & 0xFFFFFFFFFFFFFFFF
        power = (power * int(_POWER[n])) & 0xFFFFFFFFFFFFFFFF
        unpower = (unpower * int(_UNPOWER[n])) & 0xFFFFFFFFFFFFFFFF
    if not starts:
        return np.empty(0, np.uint64)
    if before:
        ended.append(np.array([carry], np.uint64))
    return _mixed((np.concatenate(ended) - np.concatenate(begun)) * np.concatenate(starts))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``k`` words; of fewer words, the whole sequence as one."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _U(_BASE) + words[i:i + n]
    return np.unique(_mixed(out))


def hash_word(word: str, keep: np.ndarray = SPACED) -> int:
    """The hash of one word given as text."""
    found = word_hashes(np.frombuffer(word.encode(), np.uint8), keep)
    if len(found) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(found[0])


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs."""
    return x.view(np.int64)
