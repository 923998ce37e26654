"""Row filters F1-F9 (F10 is a Column builder in ``functions.labels``)."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadscope.functions.text import WS_CLASS, trim_ws

# --- fixed values -------------------------------------------------------------
# Default start date of the study window.
DEFAULT_SINCE = "2015-01-01"
# Author sentinels: strict set (null also dropped) and the case-insensitive set
# (null read as '').
DELETED_STRICT = ("[deleted]",)
DELETED_LOOSE = ("[deleted]", "[removed]", "")
# A term made only of digits, whitespace and / . , - is numeric.
NUMERIC_TERM = "^(?:[0-9/.,-]|" + WS_CLASS + ")+$"
# Acronyms: upper-case terms of 3 to 6 characters.
ACRONYM_MIN, ACRONYM_MAX = 3, 6
# -----------------------------------------------------------------------------


def since(df: DataFrame, col: str = "created_utc", date: str = DEFAULT_SINCE) -> DataFrame:
    """keep rows at/after a UTC date.

    The literal has the column's own type (epoch-seconds integer, date or
    timestamp), so the comparison is a plain column-vs-literal predicate that
    reaches the Parquet scan as a pushed filter.
    """
    day = dt.date.fromisoformat(date)
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        lit = F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")
    elif isinstance(dtype, T.TimestampType):
        # an instant: midnight UTC, whatever the session or process time zone
        lit = F.lit(f"{day.isoformat()}T00:00:00Z").cast("timestamp")
    elif isinstance(dtype, T.DateType):
        lit = F.lit(day)
    else:
        lit = F.lit(calendar.timegm(day.timetuple())).cast(dtype.simpleString())
    return df.filter(F.col(col) >= lit)


def drop_deleted_authors(df: DataFrame, col: str = "author", case_insensitive: bool = True,
                         sentinels: Sequence[str] | None = None) -> DataFrame:
    """drop deleted/removed authors.

    ``case_insensitive=True``: ``lower(coalesce(author, ''))`` not in the sentinels
    (default ``[deleted]``, ``[removed]``, ''). ``False``: the strict set
    ``{[deleted], null}``. Author names such as "None" or "NA" are kept.
    """
    if case_insensitive:
        s = [x.lower() for x in (sentinels if sentinels is not None else DELETED_LOOSE)]
        return df.filter(~F.lower(F.coalesce(F.col(col), F.lit(""))).isin(s))
    s = list(sentinels if sentinels is not None else DELETED_STRICT)
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(s))


def min_text_length(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """text of at least n characters (null dropped)."""
    return df.filter(F.length(F.col(col)) >= n)


def drop_numeric_terms(df: DataFrame, col: str = "term") -> DataFrame:
    """drop terms made only of digits, whitespace and ``/ . , -``."""
    return df.filter(~F.col(col).rlike(NUMERIC_TERM))


def acronyms(df: DataFrame, col: str = "term") -> DataFrame:
    """upper-case terms of 3-6 characters (at least one cased character)."""
    t = F.col(col)
    return df.filter((F.upper(t) == t) & (F.lower(t) != t)
                     & F.length(t).between(ACRONYM_MIN, ACRONYM_MAX))


def drop_empty_body(df: DataFrame, col: str = "body") -> DataFrame:
    """drop rows whose body is null or whitespace only."""
    return df.filter(trim_ws(F.coalesce(F.col(col), F.lit(""))) != "")


def posts_only(df: DataFrame, col: str = "is_post") -> DataFrame:
    """submissions only; a missing flag means submission."""
    return df.filter(F.coalesce(F.col(col), F.lit(True)))


def kept(df: DataFrame, col: str = "keep", value: str = "yes") -> DataFrame:
    """F8: verdict equals ``value``."""
    return df.filter(F.col(col) == value)


def group_sizes(df: DataFrame, by: Sequence[str], name: str = "_n") -> DataFrame:
    """Rows per group; a partial (map-side) + final hash aggregate, safe under skew."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def min_group_size(df: DataFrame, by: Sequence[str] | str, n: int = 10) -> DataFrame:
    """keep rows whose group has at least n rows.

    Group sizes come from a partial aggregate (never a window over a whole group),
    then a semi join. The size table is derived from the data, so no broadcast is
    forced: AQE turns the join into a broadcast from the measured shuffle size, and
    its skew-join split handles a hot group on the big side otherwise.
    """
    by = [by] if isinstance(by, str) else list(by)
    big = group_sizes(df, by).filter(F.col("_n") >= n).select(*by)
    return df.join(big, by, "left_semi")
