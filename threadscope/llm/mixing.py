"""Mixing sources to target weights: Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / w``: u is uniform in (0, 1), from a digest of the document's
id, and w its quality weight. Documents sorted by key within their source are a weighted sample
without replacement of any length. A source's target first buys complete epochs (every document
once more per epoch); what remains is taken from the start of the sorted list until the sizes
reach it.

Nothing is sorted per source in one task: keys are cut into ranges of equal width in ln(key),
``(source, range)`` totals give each range its offset, and only the rows of one range meet in a window.
Whatever w is, ln(key) of a document has a density of at most 1/e per unit, so with ``steps`` ranges a
unit no range can expect more than 1 / (e * steps) of a source's documents, in any script or mix of scripts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, byte_rows, fresh, SPACED, word_count

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _measured(batches):
    for batch in batches:
        words, weights = [], []
        for text in byte_rows(batch.column("text")):
            n = word_count(text, SPACED)
            words.append(n)
            letters = int(np.count_nonzero(_LETTER[text]))
            weights.append((letters + 1.0) / (len(text) + 1.0))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), batch.column("dig"),
             pa.array(words, pa.int64()), pa.array(weights, pa.float64())],
            names=["doc_id", "source", "dig", "size", "weight"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, dig (text digest, to tell apart rows of one id), size and quality weight.

    The weight is the share of ASCII letters in the text's UTF-8 bytes, ``(letters + 1) / (bytes + 1)``.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(text).alias("dig"), text.alias("text"))
    return arrow_map(rows, _measured, "doc_id long, source string, dig long, size long, weight double")


def source_targets(totals: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target of each source, from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and divide ``share`` of all sizes;
    a target stops at ``most`` times its source's size and the excess goes to the others by weight.
    With the sources sorted by cap per weight that level is found in one pass: the first source
    that isn't capped at the level left by those before it sets the level for all the rest. The
    windows here hold one row per source.
    """
    n = len(weights)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    weighed = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    by_level = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_first())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "source", "source_size", "w", "cap",
        ((F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"),
        F.row_number().over(by_level).alias("pos"))
    free = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("pos"))
    chosen = level.withColumn("at", F.min(free).over(everything))
    final = F.min(F.when(F.col("pos") == F.col("at"), F.col("level"))).over(everything)
    return chosen.withColumn("final", final).select(
        "source", "source_size",
        F.when(F.col("pos") < F.col("at"), F.col("cap")).when(F.col("at").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("final") * F.col("w"))).alias("target"))


def sampling_key(seed: int = 0) -> Column:
    """-ln(u) / weight, u from the first 52 bits of a digest of the id; equal on every run."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / F.col("weight")


def mix(measured: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0,
        seed: int = 0, steps: int = 256) -> DataFrame:
    """How often the mix takes each document: columns of ``measured`` + source_size, target, copies, taken.

    ``copies`` is floor(target / source_size), plus 1 for documents of the fractional part: those
    whose middle word, in key order, lies before the words still wanted (so a source ends within
    half a document of its target). Rows of size 0 take no words and are kept once per epoch.
    Null sources are a source of their own; repeated rows are rows like any other. An empty table
    gives an empty result. Ties of keys go to the smaller id, then to the text digest.
    """
    keyed = measured.withColumn("key", sampling_key(seed)).withColumn(
        "range", F.floor(F.log("key") * steps).cast("int"))
    parts = keyed.groupBy("source", "range").agg(F.sum("size").alias("part"))
    totals = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part").over(
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = source_targets(totals, weights, share, most).withColumnRenamed("source", "s")
    per_range = offsets.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("range").alias("r"), "offset", "source_size", "target")
    in_range = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "dig")
    ahead = F.coalesce(F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumn("ahead", ahead).join(
        per_range, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    wanted = F.col("target") - epochs * F.col("source_size")
    extra = ((F.col("offset") + F.col("ahead") + F.col("size") / 2) < wanted).cast("long")
    return placed.withColumn("copies", epochs + extra).withColumn("taken", F.col("copies") * F.col("size")).select(
        *measured.columns, "source_size", "target", "copies", "taken")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0,
                  seed: int = 0) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` (doc_id, text, source, ...), each as often as the mix takes it."""
    i, s, d, copies, rows, takes, copy = fresh(docs, "_i", "_s", "_d", "_copies", "_rows", "_takes", "_copy")
    plan = mix(measure(docs), weights, share, most, seed).groupBy(
        F.col("doc_id").alias(i), F.col("source").alias(s), F.col("dig").alias(d)).agg(
        F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    text = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    joined = docs.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s))
                       & (text == F.col(d)))
    # rows of one id, source and text by their other columns: a rerun gives each its same share
    other = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    nth = F.row_number().over(Window.partitionBy(i, s, d).orderBy(other))
    share_of_row = F.floor(F.col(copies) / F.col(rows)) + (nth <= F.col(copies) % F.col(rows)).cast("long")
    taken = joined.withColumn(takes, share_of_row).where(F.col(takes) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(takes)))).select(
        *[docs[c] for c in docs.columns])
