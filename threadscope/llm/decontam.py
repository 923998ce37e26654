"""Benchmark decontamination by spaced-seed hashing.

A mask marks positions of a window of words; the words at the marked places are hashed together, so a
hash survives any change at the ignored places. The seeds of all benchmark items are joined with
those of every window of every text. A hit fixes how an item lies against the text: along that
diagonal the best segment is found (a match counts 1, a substitution -4, so over 4 of 5 words agree),
and it is an overlap if it covers at least ``least`` words, or the whole of a shorter item.

The segment rule trims changed words near an end, and the masks miss some patterns of changes, so an item
quoted whole is looked for on its own as well: of an item of n words, cut into n // 5 + 1 blocks, at least
one block is untouched if 4 of 5 words agree. The blocks' first words (four at most) are its seeds, and a
diagonal counts if at least 4 of 5 of all words of the item agree.

The items are dealt into blocks of bounded size; each block is sent to the tasks once and met by all
texts, so the benchmark may have any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, arrow_map, byte_rows, fresh, saved, word_hashes

#: Fixed masks: 8 of 12 words each, the last one 8 words in a row.
MASKS = ("110110101101", "111010011011", "101101110011", "11111111")
SUBSTITUTION = -4
MIN_ITEM_WORDS = 5
BLOCK_WORDS = 200_000
#: Of a whole item, one word in so many may differ; words of a block that its seed hashes at most.
WHOLE = 5
SEED_WORDS = 4
_BITS = 22
_U = np.uint64


def _seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask + "1", 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ words[i:i + n]) * _U(0x9FB21C651E98DF25)
            out ^= out >> _U(29)
    return out


def _blocks(n: int) -> list[tuple[int, int]]:
    """(place, words) of the seeds of an item of n words: one per block, a block more than words may differ."""
    m = n // WHOLE + 1
    return [(n * i // m, min(SEED_WORDS, n * (i + 1) // m - n * i // m)) for i in range(m)]


class _Seeds:
    """Sorted hashes with item and place, and a bit per cell of hashes."""

    def __init__(self, masks: list[str], found: list[np.ndarray]):
        self.masks = masks
        rows = np.concatenate(found) if found else np.empty((0, 3), np.uint64)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.hash, self.item, self.place = rows[:, 0].copy(), rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64)
        self.cells = np.zeros(1 << _BITS, bool)
        self.cells[(self.hash >> _U(64 - _BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, place in the text where the item would begin)."""
        out = []
        for m in self.masks:
            h = _seed_hashes(words, m)
            at = np.flatnonzero(self.cells[(h >> _U(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            n = hi - lo
            if n.any():
                seed = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                out.append(np.unique(np.stack([self.item[seed], np.repeat(at, n) - self.place[seed]], 1), axis=0))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


class _Index:
    """The words and seeds of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[bytes], least: int, whole: bool = False):
        self.ids = ids
        self.words = [word_hashes(np.frombuffer(t, np.uint8), ALNUM) for t in texts]
        self.least = np.array([min(least, len(w)) for w in self.words], np.int64)
        longest = max((len(m) for m in MASKS), default=0)
        short = sorted({len(w) for w in self.words if MIN_ITEM_WORDS <= len(w) < longest})
        masks = [*MASKS, *("1" * n for n in short if not whole and "1" * n not in MASKS)]
        found = []
        for m in masks:
            for i, w in enumerate(self.words):
                if len(w) < longest and (whole or len(m) != len(w)):
                    continue  # a short item is looked for whole
                h = _seed_hashes(w, m)
                found.append(np.stack([h, np.full(len(h), i, np.uint64), np.arange(len(h), dtype=np.uint64)], 1))
        self.seeds = _Seeds(masks, found)
        found, lengths = [], set()
        for i, w in enumerate(self.words):
            for at, n in _blocks(len(w)) if whole and len(w) >= MIN_ITEM_WORDS else ():
                found.append(np.array([[_seed_hashes(w[at:at + n], "1" * n)[0], i, at]], np.uint64))
                lengths.add(n)
        self.blocks = _Seeds(["1" * n for n in sorted(lengths)], found)
        width = max((len(w) for w in self.words), default=0)
        self.padded = np.zeros((len(self.words), width), np.uint64)
        for i, w in enumerate(self.words):
            self.padded[i, :len(w)] = w
        self.sizes = np.array([len(w) for w in self.words], np.int64)

    def wholes(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, place in the text where it begins, matching words) of the items quoted whole."""
        out = []
        hits = self.blocks.hits(words) if len(words) else np.empty((0, 2), np.int64)
        step = max(1, (1 << 18) // max(1, self.padded.shape[1]))
        places = np.arange(self.padded.shape[1])
        for c in range(0, len(hits), step):
            item, begin = hits[c:c + step].T
            at = begin[:, None] + places
            same = (words[np.clip(at, 0, len(words) - 1)] == self.padded[item]) & (at >= 0) & (at < len(words))
            n = (same & (places < self.sizes[item][:, None])).sum(1)
            good = np.flatnonzero((WHOLE - 1) * self.sizes[item] <= WHOLE * n)
            out += zip(item[good].tolist(), begin[good].tolist(), n[good].tolist())
        return out

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item id, first word in the text, words, matching words, first word in the item)."""
        out, diagonals = [], set()
        hits = self.seeds.hits(words) if len(words) else np.empty((0, 2), np.int64)
        for c in range(0, len(hits), 4096):
            item, begin = hits[c:c + 4096].T
            rows = np.arange(len(item))
            score = best = np.zeros(len(item), np.int64)
            start, first, last = np.zeros((3, len(item)), np.int64)
            matched = np.zeros((len(item), self.padded.shape[1] + 1), np.int64)
            for j in range(self.padded.shape[1]):
                at = begin + j
                inside = (at >= 0) & (at < len(words)) & (j < self.sizes[item])
                same = inside & (words[np.clip(at, 0, len(words) - 1)] == self.padded[item, j])
                matched[:, j + 1] = matched[:, j] + same
                fresh = score <= 0
                start = np.where(fresh, j, start)
                score = np.where(inside, np.where(fresh, 0, score) + np.where(same, 1, SUBSTITUTION), -1)
                better = score > best
                best = np.where(better, score, best)
                first, last = np.where(better, start, first), np.where(better, j + 1, last)
            n = last - first
            for r in np.flatnonzero((n >= self.least[item]) & (n >= MIN_ITEM_WORDS)):
                out.append((self.ids[item[r]], int(begin[r] + first[r]), int(n[r]),
                            int(matched[r, last[r]] - matched[r, first[r]]), int(first[r])))
                diagonals.add((int(item[r]), int(begin[r])))
        for i, b, n in self.wholes(words):
            if (i, b) not in diagonals:
                first, last = max(b, 0), min(b + int(self.sizes[i]), len(words))
                out.append((self.ids[i], first, last - first, n, first - b))
        return out


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", whole: bool = False,
             unnamed: bool = False) -> DataFrame:
    """doc_id, dig (text digest), item_id, first_word, n_words, n_matched, item_word of every overlap.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Null and
    empty texts overlap with nothing. Items of fewer than five words or without a text are not looked
    for, items without id only if ``unnamed``; items shorter than the longest mask only whole, word for
    word. With ``whole``, an item of any length also overlaps where at least 4 of 5 of all its words
    agree along a diagonal, whichever they are; words beyond the ends of the text don't agree. Repeated
    items and repeated rows give repeated overlaps.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("dig"), text.alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).dropna(
        subset=["text"] if unnamed else ["item_id", "text"])
    items = saved(items.withColumn("item", F.xxhash64("text")), "items")
    # equal items are looked for once, so that repeats neither fill a block nor are sent many times
    texts = items.groupBy("item").agg(F.min("text").alias("text"))
    total = texts.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(blocks)))
    schema = "doc_id long, dig long, item long, first_word long, n_words long, n_matched long, item_word long"
    out = None
    for b in range(blocks):
        part = dealt.where(F.col("block") == b).orderBy("item").select("item", "text").collect()  # bounded
        index = spark.sparkContext.broadcast(([r[0] for r in part], [bytes(r[1]) for r in part], least, whole))

        def run(batches, index=index):
            known = _Index(*index.value)
            for batch in batches:
                found = [(i, *o) for i, t in enumerate(byte_rows(batch.column("text"))) for o in known.overlaps(word_hashes(t, ALNUM))]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("dig").take(at),
                     *(pa.array([f[k] for f in found], pa.int64()) for k in range(1, 6))],
                    names=["doc_id", "dig", "item", "first_word", "n_words", "n_matched", "item_word"])

        found = arrow_map(rows, run, schema)
        out = found if out is None else out.unionByName(found)
    return out.join(items.select("item", "item_id"), "item").select(
        "doc_id", "dig", "item_id", "first_word", "n_words", "n_matched", "item_word")


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = 13, unnamed: bool = False) -> DataFrame:
    """doc_id, contaminated, n_items, n_words (of the longest overlap), item_id (its item, the smallest
    of equals; null if none) of every row of ``docs``. With ``unnamed``, items without
    id are looked for too; they count as one."""
    found = saved(overlaps(docs, benchmark, least, whole=True, unnamed=unnamed), "overlaps")
    best = found.groupBy(F.col("doc_id").alias("_i"), F.col("dig").alias("_d")).agg(
        (F.countDistinct("item_id") + F.max(F.col("item_id").isNull().cast("int"))).alias("n_items"),
        F.max(F.struct("n_words", (-F.col("item_id")).alias("back"))).alias("top"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("dig"))
    return rows.join(best, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("dig") == F.col("_d")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce(F.col("top.n_words"), F.lit(0)).alias("n_words"), (-F.col("top.back")).alias("item_id"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least: int = 13, unnamed: bool = False) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with ``unnamed`` with none without id either."""
    i, d = fresh(docs, "_i", "_d")
    found = saved(overlaps(docs, benchmark, least, whole=True, unnamed=unnamed).select(F.col("doc_id").alias(i), F.col("dig").alias(d)), "overlaps").distinct()
    dig = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (dig == F.col(d)), "left_anti")
