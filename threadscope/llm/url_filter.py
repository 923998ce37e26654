"""URL filters as a temporal list join.

A list is a log of dated entries: at a time a pattern (a host or domain suffix) is added to a
category or removed from it. The log becomes validity intervals ``[from, until)``, and an as-of join
evaluates every capture against the entries active at its fetch time. A pattern covers its host and
all hosts below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and final dot; '' where there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", "")
    return F.lower(F.regexp_replace(host, r"\.$", ""))


def labels(host: Column) -> Column:
    return F.split(host, r"\.")


def suffixes(host: Column, sizes: list[int] | None = None) -> Column:
    """The last n labels of the host for each n of ``sizes`` that it has (default: the host and every parent
    domain); [] of a null or empty host. With sizes, a host of many labels is only spelled out in the lengths
    asked for, not once per parent domain."""
    parts = labels(host)
    some = F.sequence(F.size(parts), F.lit(1), F.lit(-1)) if sizes is None else F.filter(
        F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.size(parts))
    return F.when(F.length(host) > 0, F.transform(
        some, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, from_ts, until_ts (null: still active) of a log (pattern, category, at, active).

    Per pattern and category the last entry of a moment holds; of equal moments an addition beats a
    removal. Repeated additions make one interval as long as they last. Entries with a null in any
    of the four columns are no entries.
    """
    log = entries.dropna(subset=["pattern", "category", "at", "active"]).groupBy(
        F.lower("pattern").alias("pattern"), "category", "at").agg(F.max("active").alias("active"))
    over = Window.partitionBy("pattern", "category").orderBy("at")
    turns = log.withColumn("was", F.coalesce(F.lag("active").over(over), F.lit(False))).where(F.col("was") != F.col("active"))
    return turns.withColumn("until_ts", F.lead("at").over(over)).where("active").select(
        "pattern", "category", F.col("at").alias("from_ts"), "until_ts")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, at_col: str) -> DataFrame:
    """id, host, fetched, blocked, categories of every capture (rows of ``captures``, repeated ones too).

    ``categories`` are those with an interval over the fetch time for the host or a parent domain,
    sorted and comma-joined ('' if none). A capture with a null time or without a host meets no
    entry. A host is looked up in the lengths (labels) that patterns have, so one of thousands of labels
    costs no more than its own length for each. Verdicts are found once per (host, time) and brought back, so a host that holds a large
    part of the captures is joined once per moment.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"),
                           F.col(at_col).alias("fetched"))
    moments = rows.where("fetched is not null and host != ''").select("host", "fetched").distinct()
    spans = intervals(entries)
    # the numbers of labels that patterns have: k different ones need a list of k * k / 2 labels at least
    sizes = sorted(r[0] for r in entries.where("pattern is not null").select(F.size(labels(F.lower("pattern")))).distinct().collect())
    asked = moments.withColumn("pattern", F.explode(suffixes(F.col("host"), sizes)))
    active = asked.join(spans, "pattern").where(
        (F.col("from_ts") <= F.col("fetched")) & (F.col("until_ts").isNull() | (F.col("fetched") < F.col("until_ts"))))
    verdicts = active.groupBy(F.col("host").alias("h"), F.col("fetched").alias("f")).agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return rows.join(verdicts, (F.col("host") == F.col("h")) & (F.col("fetched") == F.col("f")), "left").select(
        "id", "host", "fetched", F.col("categories").isNotNull().alias("blocked"), F.coalesce("categories", F.lit("")).alias("categories"))
