"""Order-dependent operators: yield curve (W4), top-k per group (T2), preview (T4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadscope.session import reliable_checkpoint

# --- fixed values -------------------------------------------------------------
# Progress is reported after every 50 processed rows (and after the last one).
DEFAULT_EVERY = 50
# Target rows per range partition of the yield curve.
ROWS_PER_RANGE = 2_000_000
# -----------------------------------------------------------------------------


def yield_curve(df: DataFrame, flag: Column, order: Sequence[str], every: int = DEFAULT_EVERY,
                processed: str = "processed", positives: str = "positives") -> DataFrame:
    """Cumulative positives after every ``every`` rows in ``order`` (and the last row).

    No single-partition window: rows are range-partitioned on the order key and
    checkpointed; per-range counts (one row per range) give each range its offset;
    positions and running sums are then windows within a range only. ``order`` must
    be a total order.
    """
    order = list(order)
    staged = df.select(*order, F.coalesce(flag.cast("int"), F.lit(0)).alias("_f"))
    n = staged.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], f"{processed} bigint, {positives} bigint")
    parts = max(1, -(-n // ROWS_PER_RANGE), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = reliable_checkpoint(staged.repartitionByRange(parts, *order)
                                 .withColumn("_pid", F.spark_partition_id()))
    per = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum("_f").alias("_y"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_row0"),
                         F.coalesce(F.sum("_y").over(before), F.lit(0)).alias("_yes0"))
    w = Window.partitionBy("_pid").orderBy(*order)
    run = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pos = ranged.join(offsets, "_pid").select(
        (F.col("_row0") + F.row_number().over(w)).cast("bigint").alias(processed),
        (F.col("_yes0") + F.sum("_f").over(run)).cast("bigint").alias(positives))
    return pos.filter((F.col(processed) % every == 0) | (F.col(processed) == n))


def top_k_per_group(df: DataFrame, by: Sequence[str] | str, order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """The first k rows per group by ``order`` (constant k -> WindowGroupLimit)."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 3) -> DataFrame:
    """T4: the first n rows in a stated order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
