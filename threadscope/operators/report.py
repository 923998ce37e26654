"""Label reports: explode (G3), frequency (A3), latency by label (A4), annotate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadscope.functions.labels import LABEL_SEPARATOR, split_labels
from threadscope.functions.scores import to_number
from threadscope.session import reliable_checkpoint


def explode_labels(df: DataFrame, col: str = "consensus_labels", out: str = "label",
                   sep: str = LABEL_SEPARATOR, keep_unlabelled: bool = True) -> DataFrame:
    """One row per (row, label); rows without labels keep one NULL label if asked."""
    fn = F.explode_outer if keep_unlabelled else F.explode
    return df.withColumn(out, fn(split_labels(col, sep)))


def label_frequency(df: DataFrame, col: str = "consensus_labels", sep: str = LABEL_SEPARATOR,
                    out: str = "n") -> DataFrame:
    """A3: label counts, most frequent first (ties by label); NULL/'' ignored."""
    e = explode_labels(df.select(col), col, "label", sep, keep_unlabelled=False)
    return e.groupBy("label").agg(F.count(F.lit(1)).alias(out)).orderBy(F.col(out).desc(), "label")


def latency_by_label(df: DataFrame, label_col: str = "consensus_labels", value_col: str = "latency_min",
                     sep: str = LABEL_SEPARATOR) -> DataFrame:
    """A4: per label ``n_posts`` (every row, NULL latency included), ``median_min`` and
    ``iqr_min`` = p75 - p25 with linear interpolation over non-null values.

    Values are read leniently (X18). The quantiles are exact and no label is gathered in one
    task: rows become (label, value, count), those are range-partitioned by (label, value) and
    checkpointed, and each range learns from one small row per (label, range) how many values
    lie before it. The ranks asked for are then picked where they fall.
    """
    staged = df.select(F.col(label_col).alias("_labels"), to_number(F.col(value_col)).alias("_v"))
    e = explode_labels(staged, "_labels", "label", sep, keep_unlabelled=False)
    counts = e.groupBy("label", "_v").agg(F.count(F.lit(1)).alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = reliable_checkpoint(counts.repartitionByRange(parts, "label", "_v").withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("label").agg(F.sum("_c").alias("n_posts"),
                                        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("_n"))
    values = ranged.where(F.col("_v").isNotNull())
    ahead = Window.partitionBy("label").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = values.groupBy("label", "_pid").agg(F.sum("_c").alias("_s")).select(
        "label", "_pid", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    run = Window.partitionBy("label", "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.join(offsets, ["label", "_pid"]).withColumn("_end", F.col("_before") + F.sum("_c").over(run)).join(
        sizes.select("label", "_n"), "label")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picks = []
    for i, q in enumerate((0.25, 0.5, 0.75)):
        rank = (F.col("_n") - 1) * q
        picks += [at(F.floor(rank)).alias(f"_lo{i}"), at(F.ceil(rank)).alias(f"_hi{i}")]
    found = placed.groupBy("label").agg(F.max("_n").alias("_m"), *picks)

    def quantile(i: int, q: float) -> Column:
        rank = (F.col("_m") - 1) * q
        part = rank - F.floor(rank)
        return F.col(f"_lo{i}") * (1 - part) + F.col(f"_hi{i}") * part

    return sizes.join(found, "label", "left").select(
        "label", "n_posts", quantile(1, 0.5).alias("median_min"), (quantile(2, 0.75) - quantile(0, 0.25)).alias("iqr_min"))


def annotate_posts(posts: DataFrame, labels: DataFrame, keys: Sequence[str],
                   col: str = "consensus_labels") -> DataFrame:
    """All posts with their consensus labels (NULL when unlabelled)."""
    return posts.join(labels.select(*keys, col), list(keys), "left")


def verdict_counts(df: DataFrame, col: str = "gpt_label", positive: str = "yes") -> DataFrame:
    """One row with the number of rows and of positive verdicts (one aggregate)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(col) == positive).alias("n_positive"))


def verdict_breakdown(df: DataFrame, col: str = "verdict", out: str = "n") -> DataFrame:
    """Rows per verdict value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out))
