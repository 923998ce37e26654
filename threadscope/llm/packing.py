"""Packing of tokenized documents into sequences of fixed length: shortest pack first over the length histogram.

A document longer than a sequence gives whole sequences and one tail. Only the histogram of the tails'
lengths (at most ``length - 1`` numbers, whatever the corpus) is packed: :func:`pack_lengths` places
lengths longest first, each into the shortest open pack, and keeps packs as groups of equal patterns
with a count. :func:`fill_gaps` then cuts the packs that hold fewest tokens and deals their tokens to
the open ends of the others, again by arithmetic on groups. Documents meet their places by rank: the
k-th tail of a length takes the k-th place of that length. Ranks come from counts per input part, so
no length, however common, is sorted or numbered in one task.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, byte_rows, id_and_text, saved
from .word_ids import text_encoder, text_groups

LENGTH = 2048
WHOLE = -1  # class of whole sequences in the counts per part


@dataclass
class Group:
    """``count`` packs of one pattern: runs of (length, how often), ``total`` tokens each."""

    count: int
    runs: tuple[tuple[int, int], ...]
    total: int


def pack_lengths(histogram: dict[int, int], length: int = LENGTH) -> list[Group]:
    """Pack ``histogram[l]`` items of each length ``l`` into packs of at most ``length``.

    Lengths are placed longest first, every item into the pack that holds fewest tokens, or into a new
    one where none has room. Packs of one group take an item each at a time, so the work depends on the
    number of lengths and groups, not of items.
    """
    heap: list[tuple[int, int, int, tuple]] = []  # total, serial number, count, runs
    serial = 0

    def keep(count: int, runs: tuple, total: int) -> None:
        nonlocal serial
        if count:
            serial += 1
            heapq.heappush(heap, (total, serial, count, runs))

    for size in sorted((l for l, n in histogram.items() if n > 0), reverse=True):
        left = histogram[size]
        if not 0 < size <= length:
            raise ValueError(f"length {size} does not fit into {length}")
        while left and heap and heap[0][0] + size <= length:
            total, _, count, runs = heapq.heappop(heap)
            used = min(count, left)
            last, times = runs[-1]
            grown = (*runs[:-1], (size, times + 1)) if last == size else (*runs, (size, 1))
            keep(used, grown, total + size)
            keep(count - used, runs, total)
            left -= used
        each = length // size
        keep(left // each, ((size, each),), size * each)
        if left % each:
            keep(1, ((size, left % each),), size * (left % each))
    return [Group(count, runs, total) for total, _, count, runs in sorted(heap, key=lambda g: (-g[0], g[1]))]


@dataclass
class Places:
    """Where the k-th tail of each length goes. ``slots[l]``: rank from which, group, offset in the pack,
    items in a row. Packs of a group from ``kept`` on are cut: their tokens stand on one line, and the
    line is cut again at the gaps of the kept packs (``gap``: its size, 0 none; ``gap_at``: where its first
    begins on the line), then at the last sequences, which are groups without items."""

    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    kept: np.ndarray
    total: np.ndarray
    first: np.ndarray
    line: np.ndarray
    gap: np.ndarray
    gap_at: np.ndarray
    sequences: int
    cut_lengths: list[int]


def _pow2(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def fill_gaps(groups: list[Group], length: int = LENGTH) -> Places:
    """Cut the emptiest packs to fill the others; what is left over makes sequences of powers of two.

    A pack whose total is ``length`` or a power of two needs no padding and stays as it is. Of the
    rest, taken from the emptiest on, as few are cut as have the tokens that all later ones lack; fewer
    than ``length`` tokens remain then.
    """
    order = sorted(range(len(groups)), key=lambda i: groups[i].total)
    open_ = [i for i in order if groups[i].total != length and not _pow2(groups[i].total)]
    lack = sum((length - groups[i].total) * groups[i].count for i in open_)
    # cutting a pack gives its tokens and takes its gap away: the balance rises by one length each
    to_cut = -(-lack // length)
    cut = [0] * len(groups)
    for i in open_:
        cut[i] = min(groups[i].count, to_cut)
        to_cut -= cut[i]
    n = len(groups)
    kept = [g.count - c for g, c in zip(groups, cut)]
    total = [g.total for g in groups]
    line, at = [0] * n, 0
    for i in order:
        line[i] = at
        at += cut[i] * total[i]
    given = at
    gap, gap_at, at = [0] * n, [given] * n, 0
    for i in open_:
        if kept[i]:
            gap[i], gap_at[i] = length - total[i], at
            at += gap[i] * kept[i]
    rest = given - at
    for bit in reversed(range(length.bit_length())):
        if rest >> bit & 1:
            kept.append(1)
            total.append(0)
            line.append(given)
            gap.append(1 << bit)
            gap_at.append(at)
            at += 1 << bit
    first = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
    slots: dict[int, list] = {}
    taken: dict[int, int] = {}
    for i, g in enumerate(groups):
        inside = 0
        for size, times in g.runs:
            slots.setdefault(size, []).append((taken.get(size, 0), i, inside, times))
            taken[size] = taken.get(size, 0) + g.count * times
            inside += size * times
    long = lambda x: np.array(x, np.int64)
    return Places({l: tuple(long(c) for c in zip(*s)) for l, s in slots.items()}, long(kept), long(total), first[:-1], long(line),
                  long(gap), long(gap_at), int(first[-1]),
                  sorted({size for g, c in zip(groups, cut) if c for size, _ in g.runs}))


def place(size: np.ndarray, rank: np.ndarray, places: Places) -> tuple[np.ndarray, ...]:
    """For tails by size and rank: row, from, to (in the tail), sequence, offset in it of every piece."""
    group, pack, offset = (np.zeros(len(size), np.int64) for _ in range(3))
    for l in np.unique(size):
        at = np.flatnonzero(size == l)
        begin, of, inside, times = places.slots[int(l)]
        s = np.searchsorted(begin, rank[at], "right") - 1
        k = rank[at] - begin[s]
        group[at], pack[at], offset[at] = of[s], k // times[s], inside[s] + k % times[s] * l
    whole = pack < places.kept[group]
    rows = np.flatnonzero(whole)
    out = [(rows, np.zeros(len(rows), np.int64), size[rows], places.first[group[rows]] + pack[rows], offset[rows])]
    rows = np.flatnonzero(~whole)
    g = group[rows]
    begin = places.line[g] + (pack[rows] - places.kept[g]) * places.total[g] + offset[rows]
    done = np.zeros(len(rows), np.int64)
    gaps = np.flatnonzero(places.gap)
    gaps = gaps[np.argsort(places.gap_at[gaps], kind="stable")]
    while len(rows):
        at = begin + done
        g = gaps[np.searchsorted(places.gap_at[gaps], at, "right") - 1]
        k, inside = np.divmod(at - places.gap_at[g], places.gap[g])
        end = np.minimum(done + places.gap[g] - inside, size[rows])
        out.append((rows, done, end, places.first[g] + k, places.total[g] + inside))
        more = end < size[rows]
        rows, begin, done = rows[more], begin[more], end[more]
    return tuple(np.concatenate(c) for c in zip(*out))


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: its place (part, seq), doc_id, doc_tokens, whole_crcs (crc32 of every whole sequence),
    wholes_before (in its part), tail_size, tail_crc, nth (of its size in its part), tail (ids, u32 LE)."""

    def run(batches):
        encode, part, seq, wholes = text_encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(length, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for begin, stop in text_groups(batch.column("text")):
                rows = batch.slice(begin, stop - begin)
                out = []
                for ids in encode([t.tobytes().decode("utf-8", "replace") for t in byte_rows(rows.column("text"))]):
                    ids = np.concatenate((np.frombuffer(ids, "<u2").astype("<u4"), end))
                    raw, full = ids.tobytes(), len(ids) // length
                    tail = raw[4 * length * full:]
                    size = len(tail) // 4
                    out.append((part, seq, len(ids), [zlib.crc32(raw[4 * length * i:4 * length * (i + 1)]) for i in range(full)],
                                wholes, size, zlib.crc32(tail), seen[size], tail))
                    seq, wholes = seq + 1, wholes + full
                    seen[size] += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns],
                                                 names=["doc_id", "part", "seq", "doc_tokens", "whole_crcs", "wholes_before",
                                                        "tail_size", "tail_crc", "nth", "tail"])

    return arrow_map(id_and_text(docs, id_col, text_col), run,
                     "doc_id long, part int, seq long, doc_tokens long, whole_crcs array<long>, wholes_before long, "
                     "tail_size int, tail_crc long, nth long, tail binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (in its document's ids), length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids and ``end_id``; null and empty texts are the end alone. Repeated rows and
    rows without id are documents of their own. Sequences hold ``length`` ids, or a power of two. An
    empty table gives no rows. ``length`` must be a power of two.
    """
    if not _pow2(length):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    rows = saved(tokenize(docs, tokenizer, end_id, length, id_col, text_col), "packing-tails")
    tails = rows.where("tail_size > 0")
    counts = tails.groupBy("part", F.col("tail_size").alias("size")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        rows.where(F.size("whole_crcs") > 0).groupBy("part").agg(F.sum(F.size("whole_crcs")).alias("n")).withColumn("size", F.lit(WHOLE)))
    counts = saved(counts, "packing-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # a row per length
    histogram.pop(WHOLE, None)
    places = fill_gaps(pack_lengths(histogram, length), length)
    sent = spark.sparkContext.broadcast(places)  # a few numbers per length and group
    ahead = F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("part").alias("p"), F.col("size").alias("s"), F.coalesce(ahead, F.lit(0)).alias("ahead"))

    def deal(batches):
        places = sent.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("tail_size", "rank"))
            row, begin, end, sequence, offset = place(size, rank, places)
            row = pa.array(row)
            cut = pa.array(end - begin < size[row])
            names = ["doc_id", "doc_tokens", "tail_crc", "part", "seq"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in names), pa.array(size[row]), pa.array(begin), pa.array(end), pa.array(sequence), pa.array(offset), cut],
                names=[*names, "size", "begin", "end", "sequence_id", "offset", "cut"])

    ranked = tails.join(before, (F.col("part") == F.col("p")) & (F.col("tail_size") == F.col("s"))).select(
        "doc_id", "doc_tokens", "tail_crc", "part", "seq", "tail_size", (F.col("ahead") + F.col("nth")).alias("rank"))
    dealt = saved(arrow_map(ranked, deal, "doc_id long, doc_tokens long, tail_crc long, part int, seq long, size long, begin long, "
                                          "end long, sequence_id long, offset long, cut boolean"), "packing-pieces")
    piece = lambda start, size, crc, sequence, offset: [
        F.col("doc_id"), start.alias("start"), size.alias("length"), crc.alias("ids_crc32"), F.col("doc_tokens"),
        sequence.alias("sequence_id"), offset.alias("offset")]
    start, size = F.col("doc_tokens") - F.col("size") + F.col("begin"), F.col("end") - F.col("begin")
    uncut = dealt.where("not cut").select(*piece(start, size, F.col("tail_crc"), F.col("sequence_id"), F.col("offset")))
    ids = rows.where(F.col("tail_size").isin(places.cut_lengths)).select(F.col("part").alias("p"), F.col("seq").alias("q"), "tail")
    bits = F.crc32(F.expr("substring(tail, cast(4 * begin + 1 as int), cast(4 * (end - begin) as int))"))
    cut = dealt.where("cut").join(ids, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q"))).select(
        *piece(start, size, bits, F.col("sequence_id"), F.col("offset")))
    whole = rows.where(F.size("whole_crcs") > 0).select("doc_id", "doc_tokens", "part", "wholes_before", F.posexplode("whole_crcs").alias("k", "crc"))
    whole = whole.join(before.where(F.col("s") == WHOLE), F.col("part") == F.col("p")).select(
        *piece(F.col("k").cast("long") * length, F.lit(length).cast("long"), F.col("crc"),
               F.lit(places.sequences) + F.col("ahead") + F.col("wholes_before") + F.col("k"), F.lit(0).cast("long")))
    return uncut.unionByName(cut).unionByName(whole)
