"""Preprocessing plan: submissions (+ their comments) -> clean, scored posts.

S5 -> J6 -> F1 -> P8 -> X4 -> F2 -> F3 -> X5 -> X6 -> K4, as one plan with a single
shuffle (the per-post comment aggregate of J6); everything after it is one narrow
projection/filter stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadscope.functions.text import clean_text, post_text
from threadscope.operators.filters import DEFAULT_SINCE, drop_deleted_authors, min_text_length, since
from threadscope.operators.latency import enrich_first_last, with_latency
from threadscope.operators.sampling import with_engagement
from threadscope.operators.sizing import with_computed


def clean_posts(posts: DataFrame, comments: DataFrame | None = None, since_date: str = DEFAULT_SINCE,
                min_chars: int = 20, title: str = "title", selftext: str = "selftext",
                since_col: str = "created_utc") -> DataFrame:
    """Keep posts from ``since_date`` with a known author and at least ``min_chars`` of
    cleaned text; add ``clean_text``, ``engagement`` and ``latency_min``.

    ``comments`` (post_id, created_utc) supply the first reply time; without them an
    existing ``first_comment_utc`` column is used. ``since_col`` is the stored column that the date is
    compared with (where ``created_utc`` is computed from it, the filter still reaches the scan).
    """
    df = since(posts, since_col, since_date)
    if comments is not None:
        df = enrich_first_last(df, comments)
    elif "first_comment_utc" not in df.columns:
        df = df.withColumn("first_comment_utc", F.lit(None).cast("bigint"))
    df = with_computed(df, "clean_text", clean_text(post_text(title, selftext)))
    df = drop_deleted_authors(df, "author", case_insensitive=False)
    df = min_text_length(df, "clean_text", min_chars)
    df = with_engagement(df)
    return with_latency(df, sec=None)
