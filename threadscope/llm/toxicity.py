"""Toxicity: a counterfactual-regularised linear classifier.

A text is the set of its words and of its runs of five bytes, hashed into cells. Counts per cell over
all labelled training rows choose the features. A logistic model over them is fitted with a penalty on
``(f(s) - f(s'))^2`` for labelled sentences s that name a group and their counterfactuals s', the same
sentence about another group or about nobody in particular: a mention by itself can't move the score.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, arrow_map, byte_rows, fresh, id_and_text, saved, word_hashes
from .sketch import CELLS, add_up, maybe_in, packed, seen_in

BITS = 20
FEATURES = 1024
#: At most so many rows of either label are used to fit the weights (the features come from all).
FIT_ROWS = 4000
FIT_SENTENCES = 4000
_U = np.uint64
_GRAM = 5

#: Words that name groups of people, and a neutral word.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu",
    "buddhist", "atheist", "black", "white", "asian", "african", "european", "american", "mexican", "immigrant", "immigrants",
    "refugees", "gay", "lesbian", "straight", "transgender", "disabled", "blind", "deaf", "old", "young")
NEUTRAL_TERM = "people"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ALNUM] = np.flatnonzero(ALNUM)
_FOLD[65:91] += 32


def cells_of(text: np.ndarray) -> np.ndarray:
    """The cells of a text's words (lower half) and five-byte runs (upper half), repeated as they occur."""
    words = word_hashes(text, ALNUM) >> _U(64 - BITS)
    folded = np.full(len(text) + 2, 32, np.uint8)
    folded[1:-1] = _FOLD[text]
    n = len(folded) - _GRAM + 1
    if n <= 0:
        return words.astype(np.int64)
    runs = np.zeros(n, np.uint64)
    for i in range(_GRAM):
        runs = (runs << _U(8)) | folded[i:i + n]
    runs = (runs * _U(0x9E3779B97F4A7C15)) >> _U(64 - BITS)
    return np.concatenate([words, runs + _U(1 << BITS)]).astype(np.int64)


def in_fold(id_col: Column, folds: int = 3, out: int = 1) -> Column:
    """Whether a row is held out: crc32 of its id as text, modulo ``folds``. A null id isn't."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == out, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """doc_id, text, y of the labelled rows to learn from; the highest label of a repeated id holds."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().where(
        ~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    seen = docs.sparkSession.sparkContext.broadcast(seen_in(y, "doc_id"))
    return saved(maybe_in(id_and_text(docs, id_col, text_col), seen, True).join(y, "doc_id").select("doc_id", "text", "y"), "labelled")


def choose_features(train: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, int, int]:
    """The cells that tell the labels apart best (G-statistic of presence), rows with label 0, with 1."""

    def run(batches):
        counts = np.zeros(4 << BITS, np.int64)  # cells of label 0, then of label 1
        for batch in batches:
            for text, y in zip(byte_rows(batch.column("text")), batch.column("y").to_pylist()):
                counts[np.unique(cells_of(text)) + (int(y > 0) << (BITS + 1))] += 1
        at, cells = packed(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(cells, pa.binary())], names=["slice", "cells"])

    rows = {r["y"]: r["n"] for r in train.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = rows.get(0, 0), rows.get(1, 0)
    if not n0 or not n1:
        return np.empty(0, np.int64), n0, n1
    c0, c1 = add_up(arrow_map(train.select("text", "y"), run, CELLS), 4 << BITS).reshape(2, -1).astype(float)
    g = np.zeros(len(c0))
    for a, n in ((c0, n0), (c1, n1)):
        for part, whole in ((a, c0 + c1), (n - a, n0 + n1 - c0 - c1)):
            expected = whole * n / (n0 + n1)
            ok = (part > 0) & (expected > 0)
            g[ok] += 2 * part[ok] * np.log(part[ok] / expected[ok])
    best = np.argsort(-g, kind="stable")[:features]
    return np.sort(best[g[best] > 10.8]), n0, n1  # p < 0.001


class _Lookup:
    """Places among the chosen features of those that a text has, by a table over all cells."""

    def __init__(self, chosen: np.ndarray):
        self.place = np.full(2 << BITS, -1, np.int16)
        self.place[chosen] = np.arange(len(chosen))

    def __call__(self, text: np.ndarray) -> np.ndarray:
        at = self.place[cells_of(text)]
        return np.unique(at[at >= 0])


def _counterfactuals(text: bytes, terms: Sequence[str]) -> list[tuple[bytes, bytes]]:
    """Sentences that name a group, each with the next term of the list and with the neutral word."""
    pattern = re.compile(rb"\b(" + b"|".join(t.encode() for t in terms) + rb")\b", re.I)
    out = []
    if pattern.search(text):
        after = {t.encode(): terms[(i + 1) % len(terms)].encode() for i, t in enumerate(terms)}
        for sentence in re.split(rb"[.!?\n]+", text):
            if pattern.search(sentence):
                out.append((sentence, pattern.sub(lambda m: after[m.group().lower()], sentence)))
                out.append((sentence, pattern.sub(NEUTRAL_TERM.encode(), sentence)))
    return out


def _fit_rows(train: DataFrame, chosen: np.ndarray, terms: Sequence[str]) -> tuple[list, list]:
    """(y, features) of at most FIT_ROWS rows of either label, and (features, features) of at most
    FIT_SENTENCES counterfactual pairs: those that come first by a digest of the document's id, of a pair
    also its place in the text, so equal texts are in the sample as often as in the table."""

    def run(batches):
        look = _Lookup(chosen)
        for batch in batches:
            ids, place, y, x, pair = [], [], [], [], []
            for i, text, label in zip(batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")), batch.column("y").to_pylist()):
                ids.append(i)
                place.append(0)
                y.append(int(label > 0))
                x.append(look(text).tobytes())
                pair.append(None)
                for at, (a, b) in enumerate(_counterfactuals(text.tobytes(), terms)):
                    ids.append(i)
                    place.append(at)
                    y.append(2)
                    x.append(look(np.frombuffer(a, np.uint8)).tobytes())
                    pair.append(look(np.frombuffer(b, np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(place, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.binary()), pa.array(pair, pa.binary())],
                names=["doc_id", "place", "y", "x", "x2"])

    rows = saved(arrow_map(train.select("doc_id", "text", "y"), run, "doc_id long, place int, y int, x binary, x2 binary"), "fit-rows")
    first = [F.xxhash64("doc_id", "place"), "doc_id", "place", "x", "x2"]
    take = lambda y, n: rows.where(F.col("y") == y).orderBy(*first).limit(n).collect()
    vector = lambda b: np.frombuffer(bytes(b), np.int16)
    texts = [(r["y"], vector(r["x"])) for y in (0, 1) for r in take(y, FIT_ROWS)]
    return texts, [(vector(r["x"]), vector(r["x2"])) for r in take(2, FIT_SENTENCES)]


def _dense(rows: Sequence[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        out[i, r] = 1
    return out


def fit(texts: list, pairs: list, width: int, penalty: float = 1.0, ridge: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent; both labels weigh the same."""
    x, y = _dense([f for _, f in texts], width), np.array([y for y, _ in texts], np.float32)
    away = _dense([a for a, _ in pairs], width) - _dense([b for _, b in pairs], width)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    w = np.zeros(width + 1, np.float32)
    v = w.copy()
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    sizes = (x * x).sum(1)
    rate = 1.0 / (0.25 * float((share * sizes).sum()) + ridge + penalty * (float((away * away).sum()) / max(len(pairs), 1)))
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (share * (p - y))
        grad[:-1] += ridge * v[:-1]
        if len(pairs):
            grad[:-1] += penalty * (away.T @ (away @ v[:-1])) / len(pairs)
        new = v - rate * grad
        v = new + (i / (i + 3)) * (new - w)
        w = new
    return w[:-1].astype(float), float(w[-1])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", terms: Sequence[str] = IDENTITY_TERMS) -> DataFrame:
    """doc_id, dig (text digest), held_out, score, predicted of every row of ``docs``.

    Learns from labelled rows outside the held-out fold only; a score depends on the text alone. Null
    texts are empty. Without labelled rows of both kinds every score is the base rate of label 1
    (0.5 if nothing is labelled). Null ids get a score and are not held out; an empty table gives no rows.
    """
    train = _labelled(docs, labels, id_col, text_col, label_col)
    chosen, n0, n1 = choose_features(train)
    if len(chosen):
        texts, pairs = _fit_rows(train, chosen, terms)
        weights, intercept = fit(texts, pairs, len(chosen))
    else:
        base = (n1 + 0.5) / (n0 + n1 + 1)
        weights, intercept = np.empty(0), float(np.log(base / (1 - base)))

    def run(batches):
        look = _Lookup(chosen)
        for batch in batches:
            z = np.array([weights[look(t)].sum() if len(weights) else 0.0 for t in byte_rows(batch.column("text"))]) + intercept
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("dig"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                names=["doc_id", "dig", "score"])

    rows = id_and_text(docs, id_col, text_col).withColumn("dig", F.xxhash64("text"))
    scored = arrow_map(rows, run, "doc_id long, dig long, score double")
    return scored.select("doc_id", "dig", in_fold(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic."""
    i, d = fresh(docs, "_i", "_d")
    bad = saved(score(docs, labels, **options).where("predicted = 1").select(
        F.col("doc_id").alias(i), F.col("dig").alias(d)).distinct(), "toxic")
    dig = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (dig == F.col(d)), "left_anti")
