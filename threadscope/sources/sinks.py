"""Writers K1-K7. All are distributed writes (one file per task); ordered outputs
are written from a range-sorted frame, so the part files concatenate in order.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_term_list(df: DataFrame, path: str, col: str = "term", mode: str = "overwrite") -> None:
    """K1: sorted unique terms, one per line (part files in code-point order)."""
    df.select(col).distinct().orderBy(col).write.mode(mode).text(path)


def append_candidates(df: DataFrame, path: str) -> None:
    """K2: append rows to a header CSV folder (every part file carries its header)."""
    (df.write.mode("append").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _by_community(df: DataFrame, by: str, pieces: int) -> DataFrame:
    """Rows of one community meet in at most ``pieces`` tasks, so a folder gets at most that many
    files and a community that holds most rows is still written by several tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(pieces))
    return df.repartition(F.col(by), salt)


def write_objects(df: DataFrame, path: str, by: str = "subreddit", mode: str = "overwrite", pieces: int = 8) -> None:
    """K3: gzip JSON lines per community (at most ``pieces`` files each); non-ASCII kept, NULL
    fields written."""
    (_by_community(df, by, pieces).write.mode(mode).partitionBy(by).option("compression", "gzip")
     .option("ignoreNullFields", False).json(path))


def write_clean(df: DataFrame, path: str, by: str | None = "subreddit", mode: str = "overwrite", pieces: int = 8) -> None:
    """K4: Parquet, one folder per community (at most ``pieces`` files each)."""
    if by:
        _by_community(df, by, pieces).write.mode(mode).partitionBy(by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: header CSV; booleans written as 1/0 as flat tables expect."""
    out = df.select(*[F.col(f"`{f.name}`").cast("int").alias(f.name) if f.dataType.typeName() == "boolean"
                      else F.col(f"`{f.name}`") for f in df.schema.fields])
    (out.write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


_VERSION = re.compile(r"v=(\d+)$")


def _versions(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """Version numbers below ``path``; ``whole``: only those whose write was committed."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    found = []
    for st in fs.listStatus(hpath):
        m = _VERSION.search(st.getPath().getName())
        if m and (not whole or fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))):
            found.append(int(m.group(1)))
    return sorted(found)


def snapshot_then_replace(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """K6: write a new version ``path/v=<n+1>``; earlier versions stay as snapshots.

    A plan that still reads version n is never overwritten under it. Returns the
    written path. Rows go to a hidden folder of this writer's own, which one rename makes the
    next version. Of writers that want the same number one gets it: the rename of the others puts
    their folder, still hidden, below the version that is there, and they take it out again and try
    the next number. So no version is lost or mixed on file systems whose rename is one step (HDFS,
    POSIX); an object store needs a committer of its own. A failed write leaves its hidden folder.
    """
    spark = df.sparkSession
    root, own = path.rstrip("/"), f"_write-{uuid.uuid4().hex}"
    df.write.mode("error").format(fmt).save(f"{root}/{own}")
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source = hpath(f"{root}/{own}")
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = (_versions(spark, path, whole=False) or [0])[-1] + 1
    while True:
        target = hpath(f"{root}/v={n}")
        if not fs.exists(target) and fs.rename(source, target):
            inside = hpath(target, own)
            if not fs.exists(inside):
                return f"{root}/v={n}"
            source = inside  # another writer was first; the next rename takes the folder out again
        n += 1


def read_latest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The newest version that ``snapshot_then_replace`` finished; half-written ones are passed over."""
    vs = _versions(spark, path)
    if not vs:
        raise FileNotFoundError(path)
    return spark.read.format(fmt).load(f"{path.rstrip('/')}/v={vs[-1]}")


def write_name_list(df: DataFrame, path: str, col: str = "name", order: str = "input_order",
                    mode: str = "overwrite") -> None:
    """K7: names one per line in input order (``order`` carries the position)."""
    df.orderBy(order).select(col).write.mode(mode).text(path)
