"""N-gram Jaccard self-join with prefix, length, positional and suffix filters, and its components.

1. One scan hashes every text into its set of word n-grams, digests the set, and counts n-grams in a
   fixed number of cells. Texts of equal sets form a class; only one member per class goes on.
2. The cells order all n-grams, rare ones first (by cell count, then hash). Of a set of n, only the
   first ``n - ceil(t n) + 1`` can hold the first n-gram shared with a partner: they become postings.
3. Postings meet by n-gram, sorted by (size, id). Neighbours that pass the length and positional
   filters are candidates; each distinct pair is checked once: first the suffix filter (n-grams per
   fixed slice of the hash space bound the overlap), then the sets themselves.
4. The links make components. In n-grams with more postings than the neighbours cover, pairs of
   *different* components follow, checked the same way: first a few per posting and round, then all
   that pass the filters. A pair inside a component needs no check, so a family of near copies costs
   a few pairs per member, not its square, and no link between components is lost.

Hot n-grams are dealt out by a salt in step 3; step 4 joins what the salt kept apart.

:func:`ngram_links` counts all links of every document. No link leaves a component, so the classes of each
are dealt into buckets of bounded size, every pair of buckets is one cell of work, and in it the overlaps
of all its pairs of sets are counted at once. A link is met in one cell only; sums leave it, not pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_long, byte_rows, fresh, id_and_text, saved, shingles, small_batches, SPACED, word_hashes
from .components import connected_components
from .sketch import CELL_BITS, add_up, may_be_in, maybe_in, packed, seen_in

NEIGHBOURS = 2
#: How far later rounds look among postings of different components, before all the rest is joined.
LATER = (8, 64)
SUFFIX_SLICES = 64
#: A bucket of classes holds about so many classes and n-grams at most; columns of a cell's matrix at a time.
BUCKET_CLASSES, BUCKET_GRAMS, COLUMNS = 256, 1 << 18, 4096
_U = np.uint64


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - CELL_BITS)).astype(np.int64)


def _scan(k: int):
    def run(batches):
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            sizes, d1, d2 = [], [], []
            for text in byte_rows(batch.column("text")):
                grams = shingles(word_hashes(text, SPACED), k)
                np.add.at(counts, _cell(grams), 1)
                digest = _digest(grams)
                sizes.append(len(grams))
                d1.append(digest[0])
                d2.append(digest[1])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "n", "d1", "d2", "slice", "cells"])
        at, cells = packed(counts)
        n = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
             pa.array(at, pa.int32()), pa.array(cells, pa.binary())], names=["doc_id", "n", "d1", "d2", "slice", "cells"])

    return run


def _postings(texts: DataFrame, order, k: int, num: int, den: int, hot: float, without=None) -> DataFrame:
    """tok, node, size << 32 | position, salt of the first ``n - ceil(t n) + 1`` n-grams of every text;
    texts whose id may be in ``without`` are left out."""

    def run(batches):
        rank = order.value
        for batch in batches:
            if without is not None:
                batch = may_be_in(batch, without.value, False)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tok, node, place, salt = [], [], [], []
            size = 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tok, node, place, salt)],
                                                  names=["tok", "node", "place", "salt"])

            for i, text in zip(ids, byte_rows(batch.column("text"))):
                grams = shingles(word_hashes(text, SPACED), k)
                n = len(grams)
                if not n:
                    continue
                cells = rank[_cell(grams)]
                first = np.argsort(cells, kind="stable")[:n - (num * n + den - 1) // den + 1]
                est = np.exp2(cells[first] / 8.0)
                pieces = np.where(est > hot, np.ceil(est / 16384), 1).astype(np.int64)
                tok.append(as_long(grams[first]))
                node.append(np.full(len(first), i, np.int64))
                place.append((n << 32) + np.arange(len(first)))
                salt.append(((int(i) * 0x9E3779B1 & 0x7FFFFFFF) % pieces + (pieces > 1)).astype(np.int32))
                size += len(first)
                if size > 100_000:
                    yield out()
                    tok, node, place, salt, size = [], [], [], [], 0
            if size:
                yield out()

    return arrow_map(texts, run, "tok long, node long, place long, salt int")


def _passes(a_place: np.ndarray, b_place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length and positional filters, the overlap bound counted from a first shared n-gram."""
    na, nb, ia, ib = a_place >> 32, b_place >> 32, a_place & 0xFFFFFFFF, b_place & 0xFFFFFFFF
    least = ((na + nb) * num + num + den - 1) // (num + den)
    return (np.minimum(na, nb) * den >= num * np.maximum(na, nb)) & (np.minimum(na - ia, nb - ib) >= least)


def _neighbours(num: int, den: int, reach: int = NEIGHBOURS):
    """Sorted postings -> candidate pairs (a < b) of neighbours up to ``reach`` places apart (of different
    components, where the postings say theirs), and the postings (b null) of n-grams whose pairs these
    don't all cover."""

    def run(batches):
        for batch in _regrouped(batches, reach):
            tok, salt, node, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tok", "salt", "node", "place"))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])
            group = np.cumsum(new) - 1
            count = np.bincount(group)[group]
            part = batch.column("component").to_numpy(zero_copy_only=False) if "component" in batch.schema.names else node
            a, b = [], []
            for d in range(1, reach + 1):
                if len(tok) > d:
                    near = (group[d:] == group[:-d]) & (part[d:] != part[:-d])
                    near[near] = _passes(place[:-d][near], place[d:][near], num, den)
                    a.append(np.minimum(node[:-d][near], node[d:][near]))
                    b.append(np.maximum(node[:-d][near], node[d:][near]))
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.empty((0, 2), np.int64)
            keep = (count > reach + 1) | (salt > 0)
            k, p = int(keep.sum()), len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((pairs[:, 0], node[keep]))), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(k, pa.int64())]),
                 pa.concat_arrays([pa.nulls(p, pa.int64()), pa.array(tok[keep])]),
                 pa.concat_arrays([pa.nulls(p, pa.int64()), pa.array(place[keep])])], names=["a", "b", "tok", "place"])

    return run


def _regrouped(batches, reach: int):
    """Arrow batches cut at a change of n-gram where there is one. A group longer than a batch goes
    on in the next together with its last rows, so that neighbours still meet."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 20_000:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        tok = whole.column("tok").to_numpy()
        change = np.flatnonzero(tok[1:] != tok[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield whole.slice(0, cut)
            held = [whole.slice(cut)]
        elif whole.num_rows > 200_000:
            yield whole
            held = [whole.slice(whole.num_rows - reach - 2)]
        else:
            held = [whole]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sets(texts: DataFrame, k: int, wanted) -> DataFrame:
    """node, n, slices (n-grams per 1/64 of the hash space, u32), grams (sorted hashes) of the texts
    whose id may be in ``wanted``."""

    def run(batches):
        for batch in batches:
            batch = may_be_in(batch, wanted.value, True)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                grams = [shingles(word_hashes(t, SPACED), k) for t in byte_rows(part.column("text"))]
                cuts = [np.bincount((g >> _U(58)).astype(np.int64), minlength=SUFFIX_SLICES).astype("<u4").tobytes() for g in grams]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(g) for g in grams], pa.int64()), pa.array(cuts, pa.binary()),
                     pa.array([g.tobytes() for g in grams], pa.binary())], names=["node", "n", "slices", "grams"])

    return arrow_map(texts, run, "node long, n long, slices binary, grams binary")


def _check(rows: DataFrame, num: int, den: int, suffix: bool) -> DataFrame:
    """Of rows (a, b, x, y) those whose sets link: by the slice bound, or by the sets themselves."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(byte_rows(batch.column("x")), byte_rows(batch.column("y"))):
                if suffix:
                    x, y = x.view("<u4").astype(np.int64), y.view("<u4").astype(np.int64)
                    both, all_ = np.minimum(x, y).sum(), int(x.sum() + y.sum())
                else:
                    x, y = x.view(np.uint64), y.view(np.uint64)
                    all_ = len(x) + len(y)
                    at = np.searchsorted(y, x)
                    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
                keep.append((num + den) * int(both) >= num * all_)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return arrow_map(rows, run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), distinct, that link; the sets of their texts are made anew from the texts."""
    spark = pairs.sparkSession
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    # a few texts more than needed, where cells coincide: cheaper than a shuffle of texts, and no pair asks for them
    wanted = spark.sparkContext.broadcast(seen_in(nodes, "node"))
    sets = saved(_sets(texts, k, wanted), "gram-sets")

    def beside(p, col):
        x, y = sets.select(F.col("node").alias("a"), F.col(col).alias("x")), sets.select(F.col("node").alias("b"), F.col(col).alias("y"))
        return p.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    likely = saved(_check(beside(pairs, "slices"), num, den, True).distinct(), "likely-pairs")
    return saved(_check(beside(likely, "grams"), num, den, False).distinct(), "linked-pairs")


def ngram_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, rep_id of every row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of word k-grams is at least num / den;
    ``component_id`` is the smallest doc_id that links reach. Texts with fewer than k words have
    their whole sequence as one k-gram; null and empty texts, and texts without words, have n = 0 and
    link with nothing. Rows with a null id link with nothing and have a null component. Rows that
    repeat an id are one document: what one of them links with, all do. An empty table gives no rows.
    ``rep_id`` is the smallest id with the same set (the class).
    """
    with small_batches(docs.sparkSession):  # all jobs with Python run in here
        return _components(docs, k, num, den, id_col, text_col)


def _components(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, also: tuple = ()) -> DataFrame:
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    scan = saved(arrow_map(texts, _scan(k), "doc_id long, n long, d1 long, d2 long, slice int, cells binary"), "gram-scan")
    rows = scan.where("n is not null").select("doc_id", "n", "d1", "d2")
    counts = add_up(scan.where("slice is not null"))
    order = spark.sparkContext.broadcast(np.minimum(np.round(8 * np.log2(1.0 + counts)), 511).astype(np.uint16))
    hot = 16 * float(counts.mean()) + 16384

    classes = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    members = saved(rows.join(classes, ["d1", "d2"], "left").select(
        "doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), *also), "gram-classes")
    copies = members.where("n > 0").groupBy("doc_id").agg(F.max(F.col("rep") == F.col("doc_id")).alias("kept")).where(
        "not kept").select("doc_id")

    maybe = spark.sparkContext.broadcast(seen_in(copies, "doc_id"))
    others = maybe_in(texts, maybe, True).join(copies, "doc_id", "left_anti").select("doc_id", "text")
    postings = _postings(texts, order, k, num, den, hot, maybe).unionByName(_postings(others, order, k, num, den, hot))
    # by size, then id: a family of near copies has the same neighbours under all its n-grams
    dealt = postings.repartition("tok", "salt").sortWithinPartitions("tok", "salt", F.shiftright("place", 32), "node")
    met = saved(arrow_map(dealt.select("tok", "salt", "node", "place"), _neighbours(num, den),
                          "a long, b long, tok long, place long"), "gram-postings")

    first = saved(met.where("b is not null").select("a", "b").distinct(), "near-pairs")
    links = _verified(first, texts, k, num, den)
    found = connected_components(links)

    # What the neighbours didn't cover, between different components only. Rounds that look at few
    # others, in a new order each, merge families of near copies before all that is left is joined.
    rest, asked = met.where("b is null").select(F.col("a").alias("node"), "tok", "place").distinct(), first
    for turn, reach in enumerate(LATER):
        mixed = _mixed_groups(rest, found)
        dealt = mixed.withColumn("salt", F.lit(0)).repartition("tok").sortWithinPartitions("tok", F.xxhash64("node", F.lit(turn)), "node")
        near = saved(arrow_map(dealt.select("tok", "salt", "node", "place", "component"), _neighbours(num, den, reach),
                               "a long, b long, tok long, place long").where("b is not null").select("a", "b").distinct().join(
                                   asked, ["a", "b"], "left_anti"), "near-pairs")
        if near.isEmpty():
            continue
        new = _verified(near, texts, k, num, den)
        asked = asked.unionByName(near)
        if not new.isEmpty():
            found = connected_components(new.unionByName(_stars(found)))
    some = _mixed_groups(rest, found)
    n, i = "cast(shiftright({0}, 32) as int)", "cast({0} & 4294967295 as int)"
    x = some.selectExpr("tok", "node a", "component ca", f"{n.format('place')} na", f"{i.format('place')} ia")
    y = some.selectExpr("tok", "node b", "component cb", f"{n.format('place')} nb", f"{i.format('place')} ib")
    late = x.join(y, "tok").where(
        f"a < b and ca != cb and least(na, nb) * {den} >= {num} * greatest(na, nb) "
        f"and least(na - ia, nb - ib) * {num + den} >= {num} * (na + nb)").select("a", "b").distinct()
    late = saved(late.join(asked, ["a", "b"], "left_anti"), "late-pairs")
    # rows that repeat an id tie their classes together
    tied = members.where("n > 0").select("doc_id", "rep").distinct()
    tied = tied.join(tied.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # the components found are stars already: only what came late moves them
    more = tied if late.isEmpty() else tied.unionByName(_verified(late, texts, k, num, den))
    final = found
    if not more.isEmpty():
        final = connected_components(more.unionByName(_stars(found)))
    rows = members.withColumn("at", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    return rows.join(final, F.when(F.col("doc_id").isNotNull(), F.col("at")) == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "at")).alias("component_id"), F.col("rep").alias("rep_id"), *also)


def ngram_links(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of ``docs``.

    ``n_links`` is the number of other documents it links with, equal texts among them, by the rules of
    :func:`ngram_components`: rows that repeat an id are one document, which links if any of its texts
    does and counts once; rows with a null id and texts without words have no links.
    """
    with small_batches(docs.sparkSession):
        return _link_counts(docs, k, num, den, id_col, text_col)


def _digest(grams: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)


def _digested(k: int):
    def run(batches):
        for batch in batches:
            d = [_digest(shingles(word_hashes(t, SPACED), k)) for t in byte_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()),
                 batch.column("text")], names=["doc_id", "d1", "d2", "text"])

    return run


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams of every set of ``a`` with every set of ``b`` (places in ``sets``)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(a), len(b)))
    for c in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - c)), np.float32)
        x[owner[lo:hi], column[lo:hi] - c] = 1
        both += x[a] @ x[b].T
    return both


def _cells(k: int, num: int, den: int):
    """Rows sorted by cell -> d1, d2, single documents of the classes it links with, and its links (e1, e2)
    with classes that hold documents of several texts."""
    names = ["d1", "d2", "links", "e1", "e2"]

    def counted(cell):
        lo, hi, bucket = (cell.column(c).to_numpy() for c in ("lo", "hi", "bucket"))
        d1, d2, single, several = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "d2", "single", "several"))
        sets = [shingles(word_hashes(t, SPACED), k) for t in byte_rows(cell.column("text"))]
        a, b = np.flatnonzero(bucket == lo), np.flatnonzero(bucket == hi)
        size = np.array([len(x) for x in sets], np.int64)
        link = np.zeros((len(sets), len(sets)), bool)
        if len(a) and len(b):
            link[np.ix_(a, b)] = (num + den) * _overlaps(sets, a, b) >= num * (size[a][:, None] + size[b])
        link |= link.T
        np.fill_diagonal(link, False)
        i, j = np.nonzero(link & several)
        n = len(i)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((d1, d1[i]))), pa.array(np.concatenate((d2, d2[i]))),
             pa.array(np.concatenate((link @ single, np.zeros(n, np.int64)))),
             pa.concat_arrays([pa.nulls(len(d1), pa.int64()), pa.array(d1[j], pa.int64())]),
             pa.concat_arrays([pa.nulls(len(d1), pa.int64()), pa.array(d2[j], pa.int64())])], names=names)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("component", "lo", "hi")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                part = batch.slice(at, end - at)
                if held and held[-1][0] != tuple(key[at]):
                    yield counted(pa.Table.from_batches([x for _, x in held]).combine_chunks().to_batches()[0])
                    held = []
                held.append((tuple(key[at]), part))
        if held:
            yield counted(pa.Table.from_batches([x for _, x in held]).combine_chunks().to_batches()[0])

    return run


def _link_counts(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    known = saved(_components(docs, k, num, den, id_col, text_col, ("d1", "d2")), "link-classes")
    held = known.where("n_shingles > 0 and doc_id is not null").select(
        "doc_id", F.col("component_id").alias("component"), F.col("n_shingles").alias("n"), "d1", "d2").distinct()
    repeats = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("several"))
    held = saved(held.join(repeats, "doc_id", "left").withColumn("several", F.coalesce("several", F.lit(False))), "link-documents")
    classes = saved(held.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.min("component").alias("component"), F.min("n").alias("n"),
        F.sum(F.expr("cast(not several as long)")).alias("single"), F.max("several").alias("several")), "link-sets")
    sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total")).where("c > 1").selectExpr(
        "component", f"greatest(ceil(c / {BUCKET_CLASSES}), ceil(total / {BUCKET_GRAMS})) buckets")
    dealt = saved(classes.join(sizes, "component").withColumn(
        "bucket", F.expr("pmod(xxhash64(d1, d2), buckets)")).withColumnRenamed("rep", "doc_id"), "link-buckets")
    wanted = spark.sparkContext.broadcast(seen_in(dealt, "doc_id"))
    texts = maybe_in(id_and_text(docs, id_col, text_col), wanted, True)
    texts = saved(arrow_map(texts, _digested(k), "doc_id long, d1 long, d2 long, text binary").join(
        dealt, ["doc_id", "d1", "d2"]).dropDuplicates(["d1", "d2"]), "link-texts")
    cells = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).select(
        "component", F.least("bucket", "other").alias("lo"), F.greatest("bucket", "other").alias("hi"), "bucket",
        "d1", "d2", "single", "several", "text").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    met = saved(arrow_map(cells, _cells(k, num, den), "d1 long, d2 long, links long, e1 long, e2 long"), "links")

    links = met.groupBy("d1", "d2").agg(F.sum("links").alias("links"))
    # Documents of several texts, by class that one of their texts is in or links with, each once.
    mine = held.where("several").select("doc_id", F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    near = met.where("e1 is not null").select("d1", "d2", "e1", "e2").unionByName(
        classes.where("several").selectExpr("d1", "d2", "d1 e1", "d2 e2"))
    around = saved(near.join(mine, ["e1", "e2"]).select("doc_id", "d1", "d2").distinct(), "links-of-several")
    one = held.where("not several").select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "single"), ["d1", "d2"]).join(
        links, ["d1", "d2"], "left").join(around.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("more")), ["d1", "d2"], "left").selectExpr(
        "doc_id", "single - 1 + coalesce(links, 0) + coalesce(more, 0) n_links")
    singles = around.join(classes.select("d1", "d2", "single"), ["d1", "d2"]).groupBy("doc_id").agg(F.sum("single").alias("n"))
    others = around.join(mine.select(F.col("doc_id").alias("other"), F.col("e1").alias("d1"), F.col("e2").alias("d2")), ["d1", "d2"]).select(
        "doc_id", "other").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("more"))
    per_document = one.unionByName(singles.join(others, "doc_id").selectExpr("doc_id", "n + more - 1 n_links"))
    return known.join(per_document, "doc_id", "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _stars(components: DataFrame) -> DataFrame:
    return components.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _mixed_groups(postings: DataFrame, components: DataFrame) -> DataFrame:
    """node, tok, place, component of the postings of n-grams that more than one component has."""
    named = saved(postings.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "rest")
    mixed = named.groupBy("tok").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("tok")
    return saved(named.join(mixed, "tok", "left_semi").select("node", "tok", "place", "component"), "mixed")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near copies: of each component of texts one row stays, the one of the smallest id.

    A row is judged by its own text: where an id repeats, or is null, each of its rows is a document by
    itself, which comes after all rows with an id of their own. Rows without words all stay."""
    (gone,) = fresh(docs, "_gone")
    ids = docs.select(F.col("doc_id").cast("long").alias("i"))
    repeats = saved(ids.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or i is null").select("i"), "repeated-ids")
    some = repeats.agg(F.count(F.lit(1)), F.max(F.col("i").isNull().cast("int"))).first()
    if not some[0]:
        copies = ngram_components(docs, **options).where("component_id != doc_id").select(F.col("doc_id").alias(gone))
        return docs.join(copies, F.col("doc_id") == F.col(gone), "left_anti")
    row, i, nth = fresh(docs, "_row", "_id", "_nth")
    last = ids.agg(F.coalesce(F.max("i"), F.lit(0))).first()[0]
    numbered = saved(docs.withColumn(nth, F.monotonically_increasing_id()), "numbered")
    again = numbered.join(repeats.select(F.col("i").alias(i)), F.col("doc_id").cast("long").eqNullSafe(F.col(i)), "left_semi").select(
        F.col(nth).alias(i), (F.lit(max(last, 0) + 1) + F.col(nth)).alias(row))
    rows = saved(numbered.join(again, F.col(nth) == F.col(i), "left").withColumn(
        row, F.coalesce(row, F.col("doc_id").cast("long"))).drop(i, nth), "rows")
    copies = ngram_components(rows, **{**options, "id_col": row}).where("component_id != doc_id").select(F.col("doc_id").alias(gone))
    return rows.join(copies, F.col(row) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
