"""Numeric Column builders: engagement (X5), reply latency (X6), lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadscope.functions.text import ColumnOrName, _c


def engagement(score: ColumnOrName, num_comments: ColumnOrName,
               awards: ColumnOrName | None = None) -> Column:
    """``score + ln(1 + num_comments) + 2 * awards``; null/absent parts count as 0."""
    aw = F.lit(0.0) if awards is None else F.coalesce(_c(awards).cast("double"), F.lit(0.0))
    return (F.coalesce(_c(score).cast("double"), F.lit(0.0))
            + F.log1p(F.coalesce(_c(num_comments).cast("double"), F.lit(0.0)))
            + F.lit(2.0) * aw)


def latency_sec(first_reply: ColumnOrName, created: ColumnOrName) -> Column:
    """Seconds from creation to first reply (epoch seconds); null when first is null or 0."""
    first = _c(first_reply)
    return F.when(first.isNotNull() & (first != 0), first - _c(created))


def latency_min(first_reply: ColumnOrName, created: ColumnOrName) -> Column:
    """The same latency in minutes (double)."""
    return latency_sec(first_reply, created).cast("double") / F.lit(60.0)


def to_number(c: ColumnOrName) -> Column:
    """Unparsable -> null (``try_cast``; a plain cast raises under ANSI mode)."""
    return _c(c).try_cast("double")
