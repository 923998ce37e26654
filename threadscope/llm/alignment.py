"""Alignment of two tokenizers' tokens over the same bytes, and which id pairs meet how often.

Each text, with a blank before it, is cut into tokens by a byte-level BPE (A) and by a piece model (B).
Where a token of both ends at the same byte a group ends; two tokens of a group are linked when their
bytes overlap.

Groups are found by diagonal run skipping over the two arrays of token ends (:func:`align`). As long as
both cut alike, the k-th next ends of A and B are equal, at a fixed shift between the two indices; the
length of such a stretch is found by doubling probes that compare whole pieces of the arrays, and is
jumped at once. Where the ends differ the group is resolved token by token, each step being one link,
which gives the shift of the next stretch.

Counts of id pairs over the corpus are summed per task, then by Spark. The frequent pairs, above a step
of the count that leaves at most ``SENT``, go to all tasks; links of rarer pairs are joined with their
counts by a shuffle. So the result is exact and what is sent is bounded whatever the corpus.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, byte_rows, id_and_text, saved
from .word_ids import WordTable, byte_bpe, many_words, text_groups, words_of

SENT = 1 << 18  # pairs sent to every task, 17 bytes each
HELD_WORDS = 400_000  # of a task's table, about 400 bytes each
_HELD = 1 << 22  # links counted in a task before equal pairs are summed


# ---------------------------------------------------------------- groups

def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups and links of two ascending arrays of token ends whose last are equal.

    Returns the first token of each group in A and in B, and each link's token in A and in B, ascending.
    """
    n = len(ends_a)
    if not n:
        return (np.empty(0, np.int64),) * 4
    raw_a, raw_b = ends_a.astype("<u4").tobytes(), ends_b.astype("<u4").tobytes()
    a, b = ends_a.tolist(), ends_b.tolist()
    starts_a, starts_b, lengths = [], [], []  # stretches of groups: one to one, or a single irregular group (length 0)
    links_a, links_b = [], []  # of irregular groups
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        starts_a.append(i)
        starts_b.append(j)
        if x == y:
            # double the probe while it agrees, then halve it: the stretch ends at i + same
            same, probe = 1, 1
            p, q = 4 * i + 4, 4 * j + 4
            while raw_a[p:p + 4 * probe] == raw_b[q:q + 4 * probe] and p < len(raw_a):
                p, q, probe = p + 4 * probe, q + 4 * probe, 2 * probe
            while probe > 1:
                probe >>= 1
                if raw_a[p:p + 4 * probe] == raw_b[q:q + 4 * probe]:
                    p, q = p + 4 * probe, q + 4 * probe
            same = min(p >> 2, n) - i
            lengths.append(same)
            i, j = i + same, j + same
        else:
            links_a.append(i)
            links_b.append(j)
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
                links_a.append(i)
                links_b.append(j)
            lengths.append(0)
            i, j = i + 1, j + 1
    lengths, starts_a, starts_b = (np.array(v, np.int64) for v in (lengths, starts_a, starts_b))
    groups = np.maximum(lengths, 1)
    step = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
    first_a, first_b = np.repeat(starts_a, groups) + step, np.repeat(starts_b, groups) + step
    # the link (i, j) of group g is number i + j - g
    single = np.repeat(lengths > 0, groups)
    one_a, one_b = first_a[single], first_b[single]
    many_a, many_b = np.array(links_a, np.int64), np.array(links_b, np.int64)
    out_a, out_b = (np.empty(len(one_a) + len(many_a), np.int64) for _ in range(2))
    number = np.arange(len(first_a))
    for la, lb, g in ((one_a, one_b, number[single]), (many_a, many_b, np.searchsorted(first_a, many_a, "right") - 1)):
        at = la + lb - g
        out_a[at], out_b[at] = la, lb
    return first_a, first_b, out_a, out_b


@lru_cache(maxsize=2)
def _numbers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id in decimal digits followed by ``,``, ``|`` or ``;`` (id + n * which): bytes and their number."""
    words = [f"{i}{end}".encode() for end in ",|;" for i in range(n)]
    size = np.array([len(w) for w in words], np.uint8)
    width = int(size.max())
    return np.frombuffer(b"".join(w.ljust(width) for w in words), np.uint8).reshape(len(words), width), size


def written(ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups, and where in it each group begins (and the end)."""
    table, sizes = _numbers(vocabulary)
    stop_a, stop_b = (np.append(f[1:], len(ids)) for f, ids in ((first_a, ids_a), (first_b, ids_b)))
    which = np.empty(len(ids_a) + len(ids_b), np.int64)
    # tokens of A stand behind the tokens of B of earlier groups; those of B behind their group's A
    entry_a, entry_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
    entry_a[stop_a - 1] += vocabulary
    entry_b[stop_b - 1] += 2 * vocabulary
    which[np.arange(len(ids_a)) + np.repeat(first_b, stop_a - first_a)] = entry_a
    which[np.arange(len(ids_b)) + np.repeat(stop_a, stop_b - first_b)] = entry_b
    size = sizes[which]
    text = table[which][np.arange(table.shape[1]) < size[:, None]]
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    return text, ends[np.append(first_a + first_b, len(which))]


# ---------------------------------------------------------------- tokens

@lru_cache(maxsize=2)
def _both(path_a: str, path_b: str):
    """word -> (ids of A, ids of B) of a blank and the word, or None where the bytes of either are other ones;
    bytes per id of A and of B; the larger vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
    _, words_a, bytes_a, size_a = byte_bpe(path_a, True)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    size_b = np.array([len(e) for e in bytes_b], np.uint32)
    blank = sp.piece_to_id("▁")

    def each_b(words):
        return [b if w else [blank] for w, b in zip(words, sp.encode(words, num_threads=1))]

    def whole_b(texts):
        return sp.encode([t[1:] for t in texts], num_threads=1)  # it puts the blank before a text itself

    def equal(ids, entries, raw):
        return b"".join([entries[i] for i in np.frombuffer(ids, "<u2").tolist()]) == raw

    def fill(words):
        found = [words_a(words), many_words(words, whole_b, each_b, size_b, "▁")]
        raw = ["", *words]
        if all(equal(b"".join(ids), entries, " ".join(raw).encode()) for ids, entries in zip(found, (bytes_a, bytes_b))):
            return zip(*found)
        return [(a, b) if equal(a, bytes_a, b" " + w.encode()) and equal(b, bytes_b, b" " + w.encode()) else None for w, a, b in zip(words, *found)]

    return WordTable(fill, HELD_WORDS), size_a, size_b, max(len(bytes_a), len(bytes_b))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links (A's id << 16 | B's id, u32 LE, ascending)
    of every text; with ``spans`` also groups: the text that the digest is of."""
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"] + ["groups"] * spans

    def run(batches):
        table, size_a, size_b, vocabulary = _both(path_a, path_b)
        for batch in batches:
            for begin, stop in text_groups(batch.column("text")):
                part = batch.slice(begin, stop - begin)
                texts = []
                for t in byte_rows(part.column("text")):
                    t = t.tobytes()
                    s = t.decode("utf-8", "replace")
                    texts.append(words_of(" " + s)[1] if t and (s.isascii() or s.encode() == t) else [])
                known = table.ready(texts)
                ids = []
                for words in texts:
                    both = [known[w] for w in words]
                    ids.append((b"", b"") if not both or None in both else tuple(map(b"".join, zip(*both))))
                ids_a, ids_b = (np.frombuffer(b"".join(x), "<u2") for x in zip(*ids))
                n_a, n_b = (np.array([len(x) // 2 for x in side], np.int64) for side in zip(*ids))
                # texts end where tokens of both end, so all of them are aligned in one go
                first_a, first_b, link_a, link_b = align(np.cumsum(size_a[ids_a], dtype=np.int64), np.cumsum(size_b[ids_b], dtype=np.int64))
                edge = np.concatenate(([0], np.cumsum(n_a)))
                group_at, link_at = np.searchsorted(first_a, edge), np.searchsorted(link_a, edge)
                keys = ids_a[link_a].astype(np.uint32) << np.uint32(16) | ids_b[link_b]
                text, mark = written(ids_a, ids_b, first_a, first_b, vocabulary) if len(ids_a) else (np.empty(0, np.uint8), np.zeros(1, np.int64))
                text = text.tobytes()
                groups = [text[mark[x]:mark[y] - 1] if y > x else b"" for x, y in zip(group_at[:-1], group_at[1:])]
                columns = [pa.array(n_a), pa.array(n_b), pa.array(np.diff(group_at)), pa.array(np.diff(link_at)),
                           pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                           pa.array([np.sort(keys[x:y]).tobytes() for x, y in zip(link_at[:-1], link_at[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, *[pa.array([g.decode() for g in groups])] * spans],
                                                 names=["doc_id", *names])

    return arrow_map(id_and_text(docs, id_col, text_col), run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                                               "groups_sha256 string, links binary" + ", groups string" * spans)


# ---------------------------------------------------------------- counts

def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, b, n, best: how many links hold the pair, and whether no other pair of its B id has more.

    ``rows`` has links as :func:`aligned` gives them."""

    def run(batches):
        held, size, keys, counts = [], 0, np.empty(0, np.uint32), np.empty(0, np.int64)

        def add():
            more, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
            return _summed(np.concatenate((keys, more)), np.concatenate((counts, n)))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for links in byte_rows(batch.column("links")):
                held.append(links.view("<u4").copy() if len(links) % 4 == 0 and links.ctypes.data % 4 == 0 else np.frombuffer(links.tobytes(), "<u4"))
                size += len(held[-1])
                if size >= _HELD:
                    keys, counts = add()
                    held, size = [], 0
                    if len(keys) >= _HELD:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = add()
        yield out()

    found = arrow_map(rows.select("links"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = found.withColumn("b", F.col("pair").bitwiseAND(0xFFFF))
    most = F.max("n").over(Window.partitionBy("b"))  # at most A's vocabulary of rows per B id
    return found.withColumn("best", F.col("n") == most)


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    Texts null, empty, not UTF-8, or whose tokens' bytes differ from a blank and the text, have no
    tokens: zeros and an empty digest. Repeated rows and rows without id each count. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = saved(aligned(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "alignment-links")
    pairs = saved(pair_counts(rows), "alignment-pairs")
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = pairs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs")).toPandas().sort_values("step", ascending=False)
    fits = steps[steps["pairs"].cumsum() <= sent_pairs]["step"]
    lowest = int(fits.min()) if len(fits) else 1 << 20
    top = pairs.where(step >= lowest).select("pair", "n", "best").toPandas().sort_values("pair")  # at most sent_pairs
    sent = spark.sparkContext.broadcast((top["pair"].to_numpy(np.uint32), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def look(links: np.ndarray):
        pair, n, best = sent.value
        keys = np.frombuffer(links.tobytes(), "<u4")
        if not len(pair):
            return keys, np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(pair, keys), len(pair) - 1)
        return keys, pair[at] == keys, n[at], best[at]

    plain = ["n_a", "n_b", "n_groups", "n_links"]

    def measure(batches):
        for batch in batches:
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, links in enumerate(byte_rows(batch.column("links"))):
                _, hit, n, best = look(links)
                n_best[i], total[i] = np.count_nonzero(hit & best), n[hit].sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", *plain)), pa.array(n_best), pa.array(total), batch.column("groups_sha256")],
                                             names=["row", "doc_id", *plain, "n_best", "count_sum", "groups_sha256"])

    def rest(batches):
        for batch in batches:
            for row, links in zip(batch.column("row").to_pylist(), byte_rows(batch.column("links"))):
                keys, hit, _, _ = look(links)
                if not hit.all():
                    keys, times = np.unique(keys[~hit], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys.astype(np.int64)), pa.array(times)], names=["row", "pair", "m"])

    measured = arrow_map(rows, measure, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                                          "n_best long, count_sum long, groups_sha256 string")
    if len(fits) == len(steps):  # every pair was sent: no link is left
        return measured.drop("row")
    rare = arrow_map(rows.select("row", "links"), rest, "row long, pair long, m long").join(
        pairs.where(step < lowest).select("pair", "n", "best"), "pair").groupBy(F.col("row").alias("r")).agg(
        F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more"))
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    return measured.join(rare, F.col("row") == F.col("r"), "left").select(
        "doc_id", *plain, (F.col("n_best") + some("more_best")).alias("n_best"), (F.col("count_sum") + some("more")).alias("count_sum"), "groups_sha256")
