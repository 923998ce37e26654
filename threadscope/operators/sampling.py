"""Engagement scoring and high-signal sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadscope.functions.scores import engagement
from threadscope.operators.filters import group_sizes

# --- fixed values -------------------------------------------------------------
# Defaults for absent or null counters.
COUNTER_DEFAULTS = {"score": 0, "num_comments": 0, "total_awards": 0}
AUTHOR_DEFAULT = "[deleted]"
# Sampling defaults: groups of at least 10 rows, top 10 %, at most 20 per group.
MIN_ROWS, TOP_PCT, CAP = 10, 10.0, 20
# -----------------------------------------------------------------------------


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """A column that is absent or null takes the default value."""
    cols = {}
    for name, value in defaults.items():
        if name in df.columns:
            cols[name] = F.coalesce(F.col(name), F.lit(value))
        else:
            cols[name] = F.lit(value)
    return df.withColumns(cols)


def with_engagement(df: DataFrame, score: str = "score", num_comments: str = "num_comments",
                    awards: str = "total_awards", out: str = "engagement") -> DataFrame:
    """X5 with P3 defaults: ``score + ln(1 + num_comments) + 2 * awards``."""
    aw = F.col(awards) if awards in df.columns else None
    sc = F.col(score) if score in df.columns else F.lit(0)
    nc = F.col(num_comments) if num_comments in df.columns else F.lit(0)
    return df.withColumn(out, engagement(sc, nc, aw))


def top_percent_capped(df: DataFrame, by: Sequence[str] | str, score: str = "engagement",
                       tiebreak: Sequence[str | Column] = (), pct: float = TOP_PCT, cap: int = CAP,
                       min_rows: int = MIN_ROWS) -> DataFrame:
    """W1 (with F9): per group keep ``min(cap, max(1, ceil(n * pct / 100)))`` top rows.

    Groups with fewer than ``min_rows`` rows are dropped. ``tiebreak`` orders rows
    with equal scores and must make the order total (the choice is then unique).

    Plan: ``row_number() <= cap`` (a constant) lets Spark insert a partial
    WindowGroupLimit before the shuffle, so at most ``cap`` rows per group leave each
    map task even for a group holding a third of the data; ``n`` comes from a partial
    aggregate joined to the (small) ranked set.
    """
    by = [by] if isinstance(by, str) else list(by)
    if not tiebreak:
        raise ValueError("tiebreak columns are required for a deterministic sample")
    order = [F.col(score).desc()] + [F.col(t) if isinstance(t, str) else t for t in tiebreak]
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap)
    sizes = group_sizes(df, by).filter(F.col("_n") >= min_rows)
    limit = F.least(F.lit(cap), F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(float(pct)) / 100.0)))
    return (ranked.join(sizes, by, "inner")
            .filter(F.col("_rn") <= limit)
            .drop("_rn", "_n"))


def group_counts(df: DataFrame, by: Sequence[str] | str, name: str = "n_posts") -> DataFrame:
    """A2: rows per group, ordered by the group key (audit table)."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name)).orderBy(*by)


def drop_report(df: DataFrame, keep: Column, by: Sequence[str] | str | None = None) -> DataFrame:
    """One row with rows (and groups) before/after a filter, from one pass.

    ``keep`` is the filter predicate; a group counts as dropped when none of its
    rows is kept.
    """
    flagged = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    if not by:
        return flagged.agg(
            F.count(F.lit(1)).alias("rows_before"),
            F.count_if(F.col("_keep")).alias("rows_after"),
        ).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))
    by = [by] if isinstance(by, str) else list(by)
    per_group = flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                                         F.count_if(F.col("_keep")).alias("_k"))
    return per_group.agg(
        F.sum("_n").alias("rows_before"),
        F.sum("_k").alias("rows_after"),
        F.count(F.lit(1)).alias("groups_before"),
        F.count_if(F.col("_k") > 0).alias("groups_after"),
    ).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"),
        "groups_before", "groups_after",
        (F.col("groups_before") - F.col("groups_after")).alias("groups_dropped"))


def select_high_signal(df: DataFrame, by: str = "subreddit", tiebreak: Sequence[str] = ("post_id",),
                       author: str | None = "author", pct: float = TOP_PCT, cap: int = CAP,
                       min_rows: int = MIN_ROWS, posts_only: bool = False) -> DataFrame:
    """The sampling stage: drop deleted authors, score, keep big groups, take the top share.

    ``posts_only=False`` samples comments too.
    """
    from threadscope.operators.filters import drop_deleted_authors
    from threadscope.operators.filters import posts_only as _posts_only

    if posts_only:
        df = _posts_only(df)
    if author and author in df.columns:
        df = drop_deleted_authors(df, author, case_insensitive=True)
    df = with_engagement(df)
    return top_percent_capped(df, by, "engagement", list(tiebreak), pct, cap, min_rows)
