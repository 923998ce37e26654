"""Key-set relations: restrict (J10), only-new (J11/U4), union (U1/U2), intersection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restrict_to(df: DataFrame, names: DataFrame, col: str = "subreddit", name_col: str | None = None
                ) -> DataFrame:
    """Rows whose ``col`` is on the list (left semi join).

    The planner picks the join; AQE broadcasts the list when its measured size allows.
    """
    n = names.select(F.col(name_col or col).alias(col)).distinct()
    return df.join(n, col, "left_semi")


def only_new(df: DataFrame, done: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Rows whose key is not in ``done`` (left anti join)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(done.select(*keys), keys, "left_anti")


def union_terms(*frames: DataFrame, col: str = "term") -> DataFrame:
    """U1 + T1: distinct union of term columns, sorted by code point."""
    out = None
    for f in frames:
        part = f.select(F.col(f.columns[0]).alias(col)) if col not in f.columns else f.select(col)
        out = part if out is None else out.unionByName(part)
    return out.distinct().orderBy(col)


def union_inputs(*frames: DataFrame) -> DataFrame:
    """Several inputs as one table (columns matched by name, missing ones NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys present in every frame — one shuffle for any number of frames.

    Each frame contributes its distinct keys tagged with its index; a key survives
    when all indexes are seen. Equivalent to chained ``intersect`` (which would
    shuffle once per frame).
    """
    keys = list(keys)
    tagged = None
    for i, f in enumerate(frames):
        part = f.select(*keys).withColumn("_src", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    return (tagged.groupBy(*keys).agg(F.size(F.collect_set("_src")).alias("_m"))
            .filter(F.col("_m") == len(frames)).select(*keys))


def distinct_terms(df: DataFrame, col: str = "term") -> DataFrame:
    """A10: the set of stripped, non-blank terms."""
    from threadscope.functions.text import trim_ws

    return df.select(trim_ws(F.col(col)).alias(col)).where(F.col(col) != "").distinct()


def sorted_terms(df: DataFrame, col: str = "term") -> DataFrame:
    """Terms in code-point order (binary string ordering)."""
    return df.orderBy(F.col(col).asc())
