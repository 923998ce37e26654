"""Readers S1-S9. Schemas are explicit wherever the shape is known, so no inference
pass runs over the data and absent fields arrive as NULL.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadscope.functions.text import model_name_from_path, trim_ws, without_broken_bytes
from threadscope.operators.consensus import keep_first
from threadscope.session import ship_package
from threadscope.sources.csv_records import read_quoted_csv

# --- fixed values -------------------------------------------------------------
CATALOG_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("public_description", T.StringType()),
    T.StructField("subscribers", T.LongType()),
    T.StructField("over18", T.BooleanType()),
    T.StructField("_corrupt_record", T.StringType()),
])
FLAT_OBJECT_SCHEMA = T.StructType([
    T.StructField("is_post", T.BooleanType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("score", T.LongType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("first_comment_utc", T.LongType()),
    T.StructField("last_comment_utc", T.LongType()),
])
# Ontology elements: label element, exact-synonym element.
ONTOLOGY_LABEL = "rdfs:label"
ONTOLOGY_SYNONYM = "oboInOwl:hasExactSynonym"
LABEL_KEYS = ("subreddit", "post_id")
# -----------------------------------------------------------------------------

_LITERAL = T.ArrayType(T.StructType([
    T.StructField("_VALUE", T.StringType()),
    T.StructField("_xml:lang", T.StringType()),
]))


def read_ontology_terms(spark: SparkSession, path: str, row_tags: Sequence[str] | None = None,
                        label_el: str = ONTOLOGY_LABEL, synonym_el: str = ONTOLOGY_SYNONYM,
                        lang: str = "en") -> DataFrame:
    """S1 + U1 + A10: distinct stripped labels (no language or ``lang``) and exact
    synonyms (any language) of every subject, one ``term`` column.

    The rows read are the label and synonym elements themselves, wherever they stand: what the subject
    around them is called, how its start tag is written and whether it has a name does not matter, and
    there are two reads for any number of subject kinds. ``row_tags`` restricts the subjects to the given
    elements, at a read each. A language that an outer element sets is not passed on.
    """
    text = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())])

    def rows(tag: str, schema: T.StructType) -> DataFrame:
        return (spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false")
                .schema(schema).load(path))

    if row_tags is None:
        spoken = F.col("`_xml:lang`").isNull() | (F.col("`_xml:lang`") == lang)
        found = rows(label_el, text).where(spoken).select("_VALUE").unionByName(rows(synonym_el, text).select("_VALUE"))
        terms = found.select(trim_ws(F.col("_VALUE")).alias("term"))
        return terms.where(F.col("term").isNotNull()).distinct()
    schema = T.StructType([T.StructField(label_el, _LITERAL), T.StructField(synonym_el, _LITERAL)])
    out = None
    for tag in row_tags:
        none = F.array().cast(_LITERAL)
        labels = F.filter(F.coalesce(F.col(f"`{label_el}`"), none),
                          lambda v: v["_xml:lang"].isNull() | (v["_xml:lang"] == lang))
        both = F.concat(labels, F.coalesce(F.col(f"`{synonym_el}`"), none))
        part = rows(tag, schema).select(F.explode(both).alias("v")).select(trim_ws(F.col("v._VALUE")).alias("term"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("term").isNotNull()).distinct()


def read_term_list(spark: SparkSession, path: str, col: str = "term") -> DataFrame:
    """One term per line, stripped, blank lines dropped."""
    return (spark.read.text(path).select(trim_ws(F.col("value")).alias(col))
            .where(F.col(col) != ""))


def read_catalog_dump(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """S3: community catalogue JSON lines (any Hadoop codec, by file extension).

    Malformed lines are kept in ``_corrupt_record`` (PERMISSIVE) instead of failing
    the file; absent text fields read as ''. Bytes that are not UTF-8 are left out of their line before
    it is parsed, so a line that holds some keeps its fields. Blank lines are no lines.
    """
    lines = spark.read.text(paths)
    valid = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(without_broken_bytes("value"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    df = (lines.select(valid.alias("value")).where(trim_ws("value") != "")
          .select(F.from_json("value", CATALOG_SCHEMA, options).alias("r")).select("r.*"))
    return df.withColumns({
        "name": F.coalesce("name", F.lit("")),
        "title": F.coalesce("title", F.lit("")),
        "public_description": F.coalesce("public_description", F.lit("")),
    })


# A JSON text may nest this deep before its inner ``replies`` become pieces of their own.
CUT_DEPTH = 32
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def cut_replies(line: str, depth: int = CUT_DEPTH) -> list[str]:
    """A thread too deep for the JSON parser as shallow texts: the thread itself and, for every
    ``replies`` array that begins ``depth`` levels down, ``{"_fragment": true, ..., "comments": [...]}``
    with the thread's community and id. One pass over the text, no recursion; [] if it is malformed.
    """
    done: list[str] = []
    open_: list[tuple[list[str], int]] = [([], 0)]  # text so far and the level it began at
    level = at = 0
    last = ""
    for m in _TOKEN.finditer(line):
        sign = m.group()
        open_[-1][0].append(line[at:m.start()])
        at = m.end()
        if sign in "[{":
            if sign == "[" and last == '"replies"' and level - open_[-1][1] >= depth:
                open_[-1][0].append("[]")
                open_.append(([], level))
            open_[-1][0].append(sign)
            level += 1
        elif sign in "]}":
            level -= 1
            if level < 0:
                return []
            open_[-1][0].append(sign)
            if len(open_) > 1 and level == open_[-1][1]:
                done.append("".join(open_.pop()[0]))
        else:
            open_[-1][0].append(sign)
            last = sign
    open_[-1][0].append(line[at:])
    root = "".join(open_[-1][0])
    try:
        thread = json.loads(root)
        head = json.dumps({"_fragment": True, "subreddit": thread.get("subreddit"), "id": thread.get("id")})
    except (ValueError, AttributeError, RecursionError):
        return []
    if level or len(open_) > 1:
        return []
    return [root, *(f'{head[:-1]}, "comments": {f}}}' for f in done)]


def read_threads(spark: SparkSession, paths: str | Sequence[str], col: str = "thread",
                 min_partitions: int | None = None) -> DataFrame:
    """Nested thread JSON lines (``.jsonl`` or ``.jsonl.gz``) -> one VARIANT column.

    No line is lost. A line nested deeply (it doesn't parse, or closes many levels at once) becomes
    several rows: the thread with its upper levels, and fragments that hold the replies below
    (``cut_replies``; G1 knows them), so the levels below are taken apart side by side. A
    line that is no JSON object has a NULL thread and its text in ``_corrupt_record``. Blank lines
    are no lines. A gzip file is read by one task (not splittable); ``min_partitions`` spreads the
    parsed rows before the heavy work.
    """
    ship_package(spark)
    cut = F.pandas_udf(_cut_all, T.ArrayType(T.StringType()))
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.withColumn(col, F.try_parse_json("value"))
    deep = F.col(col).isNull() | F.col("value").rlike(r"(?:[\]}]\s*){%d}" % CUT_DEPTH)
    # only deep or malformed lines reach Python
    pieces = parsed.withColumn("_piece", F.explode_outer(cut(F.when(deep, F.col("value")))))
    thread = F.coalesce(F.try_parse_json("_piece"), F.when(F.col("_piece").isNull(), F.col(col)))
    thread = F.when(F.schema_of_variant(thread).startswith("OBJECT"), thread)
    df = pieces.select(thread.alias(col), F.col("value")).select(
        col, F.when(F.col(col).isNull(), F.col("value")).alias("_corrupt_record"))
    return df.repartition(min_partitions) if min_partitions else df


def _cut_all(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else cut_replies(x) or None)


def read_flat_objects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Flat submission/comment objects; a missing ``is_post`` means submission."""
    df = spark.read.schema(FLAT_OBJECT_SCHEMA).json(paths)
    return df.withColumn("is_post", F.coalesce("is_post", F.lit(True)))


def read_catalog_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None
                     ) -> DataFrame:
    """Quoted CSV whose descriptions may hold newlines and quotes; a large file is read by many tasks."""
    return read_quoted_csv(spark, path, {"escape": '"', "quote": '"'}, schema)


_BLANK_HEADER = re.compile(r"^_c\d+$")


def read_flat_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None
                  ) -> DataFrame:
    """Flat table CSV (plain or .gz); blank-named columns dropped, names stripped.

    Only empty fields become NULL (no "NA"/"None" guessing).
    """
    df = read_quoted_csv(spark, path, {"escape": '"', "nullValue": "", "emptyValue": ""}, schema)
    keep = [c for c in df.columns if c.strip() and not _BLANK_HEADER.match(c)]
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in keep])


def read_label_files(spark: SparkSession, paths: Sequence[str], keys: Sequence[str] = LABEL_KEYS,
                     labels_col: str = "labels", first_only: bool = True) -> DataFrame:
    """S8 + W2: per-model label CSVs as one long table ``(keys..., model, labels)``.

    Each path (a file, or a folder of part files) is read by its own header, so files may order or
    extend their columns differently. Every column is a string and an empty cell stays ''. The model
    is the file stem without ``labels_``. A key that a file repeats keeps its first row
    (``first_only``). At least two files are required, and each must carry the key columns and the
    labels column.
    """
    paths = list(paths)
    if len(paths) < 2:
        raise ValueError("need at least two label files for a consensus")
    options = {"escape": '"', "nullValue": "\u0000", "emptyValue": ""}
    out = None
    path = F.col("file")
    # a folder written by Spark holds part files: the folder names the model
    folder = F.regexp_extract(path, r"([^/]+)/part-[^/]*$", 1)
    model = model_name_from_path(F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]*)$", 1)))
    for p in paths:
        raw = read_quoted_csv(spark, p, options, place=True)
        missing = [k for k in (*keys, labels_col) if k not in raw.columns[3:]]
        if missing:
            raise ValueError(f"{p} lacks columns {missing}")
        part = raw.select(*keys, model.alias("model"), F.coalesce(F.col(labels_col), F.lit("")).alias("labels"),
                          path.alias("_file"), F.col("start").alias("_start"), F.col("at").alias("_at"))
        out = part if out is None else out.unionByName(part)
    if first_only:
        out = keep_first(out, [*keys, "model"], ["_file", "_start", "_at"])
    return out.select(*keys, "model", "labels")


def read_by_period(spark: SparkSession, root: str, months: Sequence[str] | None = None,
                   col: str = "month", fmt: str = "parquet") -> DataFrame:
    """A table partitioned by ``month=YYYY-MM``; only the requested months are read
    (partition pruning on the directory column)."""
    df = spark.read.format(fmt).load(root)
    if months:
        df = df.filter(F.col(col).isin(list(months)))
    return df


def period_paths(root: str, months: Sequence[str], template: str = "*{month}*") -> list[str]:
    """S9 for dumps named by period (e.g. ``RS_2024-01.zst``): one glob per requested
    ``YYYY-MM``, so files of other months are never listed or opened."""
    for m in months:
        if not re.fullmatch(r"\d{4}-\d{2}", m):
            raise ValueError(f"period must be YYYY-MM: {m!r}")
    return [f"{root.rstrip('/')}/{template.format(month=m)}" for m in months]
