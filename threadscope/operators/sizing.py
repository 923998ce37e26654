"""Plan helpers: spreading single-split inputs, and computing an expensive column once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition of a source read that has fewer partitions than the cluster's cores.

    For CPU-heavy per-row work (regex cleaning, substring matching) on an input with few splits
    (e.g. a single Parquet row group). Inputs with more splits than cores stay as they are. An
    explicit partition count is not coalesced by AQE. Use it on a source read: the partition count
    of a frame with shuffles is only known after running them.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def with_computed(df: DataFrame, name: str, col) -> DataFrame:
    """Add an expensive column that later filters read, evaluated exactly once.

    Catalyst pushes a filter on a projected column below the projection by inlining
    the expression (so e.g. a regex chain runs twice, in the filter and in the output)
    and below a round-robin repartition (back into the scan task). A one-element
    lateral view is a boundary for both: filters on generator output stay above it.
    """
    return df.select("*", F.explode(F.array(col)).alias(name))
