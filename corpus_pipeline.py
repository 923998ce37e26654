"""A training corpus from ``documents``: toxic documents and near copies go, texts that hold benchmark
items go, sources are mixed to their targets, and the rest is written as token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; :func:`run` writes it as Parquet and reads it
back as the docs of the next. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadscope.llm import decontam, huffman, mixing, ngram_join, toxicity
from threadscope.llm.common import read_table, saved
from threadscope.llm.queries import tokenizer_path
from threadscope.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"), unnamed=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return huffman.token_files(docs, scratch_path(spark, "corpus-token-files"), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: No SQL: the classifier, the sampling order by digest and the tokenizer have none; tests/llm holds each
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
