"""Reply timing: first/last reply (A1), enrichment (J6), latency (X6), fastest/slowest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadscope.functions.scores import latency_min, latency_sec


def first_last_reply(comments: DataFrame, by: str = "post_id", time: str = "created_utc",
                     first: str = "first_comment_utc", last: str = "last_comment_utc") -> DataFrame:
    """A1: earliest and latest comment time per post (partial + final hash aggregate)."""
    return comments.groupBy(by).agg(F.min(time).alias(first), F.max(time).alias(last))


def enrich_first_last(posts: DataFrame, comments: DataFrame, post_key: str = "post_id",
                      comment_post_key: str = "post_id", time: str = "created_utc",
                      first: str = "first_comment_utc", last: str = "last_comment_utc") -> DataFrame:
    """Posts left-joined with their comments' min/max time; no comment -> nulls.

    Comments are reduced to one row per post before the join, so a post with a huge
    thread costs one row in the join, not its whole thread.
    """
    agg = first_last_reply(comments, comment_post_key, time, first, last)
    if comment_post_key != post_key:
        agg = agg.withColumnRenamed(comment_post_key, post_key)
    return posts.join(agg, post_key, "left")


def with_latency(df: DataFrame, first: str = "first_comment_utc", created: str = "created_utc",
                 sec: str | None = "latency_sec", minutes: str = "latency_min") -> DataFrame:
    """Latency in seconds and minutes; null when there is no (or a zero) first reply."""
    cols = {minutes: latency_min(first, created)}
    if sec:
        cols = {sec: latency_sec(first, created), **cols}
    return df.withColumns(cols)


def latency_rank(df: DataFrame, n: int = 20, fastest: bool = True, col: str = "latency_min",
                 tiebreak: str = "post_id") -> DataFrame:
    """The n fastest (or slowest) rows with a latency; ties broken by ``tiebreak``.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps its own
    top n, so only n rows per task reach the final merge.
    """
    o = F.col(col).asc() if fastest else F.col(col).desc()
    return df.filter(F.col(col).isNotNull()).orderBy(o, F.col(tiebreak).asc()).limit(n)
