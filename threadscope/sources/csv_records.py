"""Quoted CSV whose fields may hold line ends, read by as many tasks as the files have splits.

A task that starts in the middle of a file does not know whether its first line is inside a quoted
field. So the files are read twice. The survey runs both cases for every split and keeps how each ends:
a function from two states to two states. A window over each file's splits composes these functions, which
gives the state that every split really starts with. The second read cuts the lines of each split into
records; records that go over the end of a split come as fragments and are put together by file and
the split they began in. Records are parsed by Spark's own CSV parser.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadscope.session import ship_package

Path = str | Sequence[str]


def inside_after(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, given how it starts. A quote opens at the start of a
    field only; two quotes inside are one character; after the closing quote the field goes on to the comma."""
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(',"') + 1
            if not at:
                return False
        at += 1
    while True:
        close = line.find('"', at)
        if close < 0:
            return True
        if line.startswith('"', close + 1):
            at = close + 2
            continue
        at = line.find(",", close + 1)
        if at < 0:
            return False
        if not line.startswith('"', at + 1):
            at = line.find(',"', at + 1)
            if at < 0:
                return False
        at += 2


def _lines(spark: SparkSession, path: Path) -> DataFrame:
    """value, file, start (of its split) of every line, in order within a split."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batch: pa.RecordBatch):
    """((file, start), values) of every run of lines of one split."""
    names = batch.column("file").dictionary_encode()
    which, starts = names.indices.to_numpy(), batch.column("start").to_numpy()
    edges = np.flatnonzero((which[1:] != which[:-1]) | (starts[1:] != starts[:-1])) + 1
    for begin, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(which)]):
        if stop > begin:
            yield (names.dictionary[int(which[begin])].as_py(), int(starts[begin])), batch.column("value").slice(begin, stop - begin).to_pylist()


def split_states(spark: SparkSession, path: Path) -> DataFrame:
    """file, start, inside: whether the split's first line is inside a quoted field."""
    ship_package(spark)

    def survey(batches):
        key, ends = None, (False, True)
        for batch in batches:
            for split, values in _by_split(batch):
                if split != key:
                    if key:
                        yield row(key, ends)
                    key, ends = split, (False, True)
                for value in values:
                    if value is not None:
                        ends = tuple(inside_after(value, e) for e in ends) if ends[0] != ends[1] else (inside_after(value, ends[0]),) * 2
        if key:
            yield row(key, ends)

    def row(key, ends):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([ends[0]]), pa.array([ends[1]])],
                                          names=["file", "start", "from_outside", "from_inside"])

    # lines without a quote change nothing: their text stays behind
    quoted = _lines(spark, path).withColumn("value", F.when(F.col("value").contains('"'), F.col("value")))
    ends = quoted.mapInArrow(survey, "file string, start long, from_outside boolean, from_inside boolean")
    # a split forgets its start (both cases end alike), or turns it, or leaves it
    forgets, turns = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    turned = ends.withColumn("turned", F.sum(turns.cast("long")).over(to_here))
    known = F.last(F.when(forgets, F.struct(F.col("from_outside").cast("long").alias("state"), "turned")), ignorenulls=True).over(before)
    at_start = F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    since = at_start - F.coalesce(known["turned"], F.lit(0)) + F.coalesce(known["state"], F.lit(0))
    return turned.select("file", "start", (since % 2 == 1).alias("inside"))


def csv_records(spark: SparkSession, path: Path) -> DataFrame:
    """file, start, at (its place in the split it begins in), first (of the file), record: every record's text.

    Splits are surveyed now. Reading them later with another split size is an error, not a wrong result.
    """
    states = {(r["file"], r["start"]): r["inside"] for r in split_states(spark, path).collect()}  # a row per split
    sent = spark.sparkContext.broadcast(states)

    def cut(batches):
        key, inside, at, open_ = None, False, 0, []

        def head():  # what is open at the end of a split goes on in the next one
            return [(key[0], key[1], at, key[1] == 0 and at == 0, "\n".join(open_), True)] if open_ else []

        for batch in batches:
            out = []
            for split, values in _by_split(batch):
                if split != key:
                    out += head()
                    key = (file, start) = split
                    if key not in sent.value:
                        raise RuntimeError(f"the splits of {file} are not those that were surveyed: read it again")
                    inside, at, open_ = sent.value[key], -1 if sent.value[key] else 0, []
                for value in values:
                    if inside or '"' in value:
                        inside = inside_after(value, inside)
                    open_.append(value)
                    if not inside:
                        out.append((file, start, at, start == 0 and at == 0, "\n".join(open_), at < 0))
                        at, open_ = at + 1, []
            if out:
                yield rows(out)
        if open_:
            yield rows(head())

    def rows(out):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["file", "start", "at", "first", "record", "part"])

    found = _lines(spark, path).mapInArrow(cut, "file string, start long, at long, first boolean, record string, part boolean")
    whole = found.where("not part").drop("part")
    if any(states.values()):  # some split begins inside a record
        # the last record of a file may be left open; a fragment at -1 goes on from the fragment before it
        begun = F.last(F.when(F.col("at") >= 0, F.struct("start", "at", "first")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start", "at"))
        parts = found.where("part").withColumn("of", begun).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("start", "at", "record"))).alias("parts"))
        joined = parts.select("file", "of.start", "of.at", "of.first", F.array_join(F.col("parts.record"), "\n").alias("record"))
        return whole.unionByName(joined)
    return whole.unionByName(found.where("part and at >= 0").drop("part"))


def cuts_files(spark: SparkSession, path: Path) -> bool:
    """Whether a file is larger than ``spark.sql.files.maxPartitionBytes``, so that one task should not read it
    alone (only the folder is listed)."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    return largest > _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit.removesuffix("b") or ("b" if unit else "")]


def read_quoted_csv(spark: SparkSession, path: Path, options: dict[str, str | bool], schema: T.StructType | str | None = None,
                    place: bool = False) -> DataFrame:
    """Rows of CSV files with a header each, by Spark's CSV ``options``; without ``schema`` all columns of the
    first header, as strings. ``place`` adds file, start and at, which order the rows. Spark's own reader, which
    takes a file per task, reads files of up to one split, and folders partitioned by a column."""
    reader = spark.read.option("header", True).option("multiLine", True).options(**options)
    if schema is None:
        schema = reader.csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not cuts_files(spark, path) or spark.read.text(path).columns != ["value"]:
        rows = reader.schema(schema).csv(path)
        spot = [F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("start"), F.monotonically_increasing_id().alias("at")]
        return rows.select(*spot, *[F.col(f"`{c}`") for c in schema.fieldNames()]) if place else rows
    records = csv_records(spark, path).where("not first").withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record != ''")
    parsed = F.from_csv("record", schema.toDDL() if hasattr(schema, "toDDL") else schema.simpleString(), {**options, "multiLine": True})
    columns = [F.col("row").getField(f.name).alias(f.name) for f in schema.fields]
    return records.withColumn("row", parsed).select(*(["file", "start", "at"] if place else []), *columns)
