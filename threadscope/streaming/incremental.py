"""Incremental ingestion with Structured Streaming.

Each input file is processed once: the file source records what it has read in
the checkpoint, ``trigger(availableNow=True)`` drains what is new and stops, and a
second run sees only files added since. Sinks are exactly-once file sinks or
``foreachBatch`` writes keyed by batch id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadscope.operators.relations import only_new
from threadscope.sources.sinks import _versions, read_latest, snapshot_then_replace


def ingest_new_files(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                     schema: T.StructType, fmt: str = "parquet",
                     transform: Callable[[DataFrame], DataFrame] | None = None,
                     options: dict | None = None, max_files_per_trigger: int | None = None) -> int:
    """Append every not-yet-seen file of ``source_dir`` to ``sink_dir`` (Parquet).

    Returns the number of micro-batches run. ``transform`` is applied to the stream
    (any stateless DataFrame transformation).
    """
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    if transform:
        stream = transform(stream)
    q = (stream.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    progress = q.recentProgress
    return len(progress)


def label_incremental(df: DataFrame, done: DataFrame, keys: Sequence[str],
                      label: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Only rows not labelled yet go through ``label``; callers append the result."""
    return label(only_new(df, done, keys))


def dedupe_stream(stream: DataFrame, key_col: str = "name", fold: bool = True,
                  event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Names seen before (case-folded) are ignored, across micro-batches and runs.

    By default the state holds every key seen (unbounded, like a seen-set; use the
    RocksDB state store for large key sets). With ``event_time`` and ``delay`` the
    state is bounded by a watermark (``dropDuplicatesWithinWatermark``): a key is
    forgotten once the watermark passes its first sighting plus ``delay``.
    """
    k = F.lower(F.col(key_col)) if fold else F.col(key_col)
    staged = stream.withColumn("_seen_key", k)
    if event_time and delay:
        return (staged.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_seen_key"])
                .drop("_seen_key"))
    return staged.dropDuplicates(["_seen_key"]).drop("_seen_key")


def first_last_reply_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                            checkpoint_dir: str, by: str = "post_id", time: str = "created_utc",
                            fmt: str = "parquet") -> int:
    """I4: running min/max comment time per post, written as upserts per micro-batch.

    Update mode without a watermark keeps every key's state, so no late comment is
    dropped. Each micro-batch writes its updated rows to a folder of its own (a replayed
    batch replaces it); ``latest_first_last`` reads the newest row per key and
    ``compact_first_last`` shortens what it has to read.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    agg = stream.groupBy(by).agg(F.min(time).alias("first_comment_utc"),
                                 F.max(time).alias("last_comment_utc"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return len(q.recentProgress)


def _newest(log: DataFrame, by: str) -> DataFrame:
    newest = F.max_by(F.struct("first_comment_utc", "last_comment_utc", "batch_id"), F.col("batch_id"))
    return (log.groupBy(by).agg(newest.alias("_v"))
            .select(by, "_v.first_comment_utc", "_v.last_comment_utc", "_v.batch_id"))


def _log(spark: SparkSession, sink_dir: str, by: str, snapshots: str | None) -> DataFrame:
    """The newest snapshot and the batches after it (older batch folders are pruned)."""
    log = spark.read.parquet(sink_dir).select(by, "first_comment_utc", "last_comment_utc", F.col("batch_id").cast("bigint"))
    if snapshots is None or not _versions(spark, snapshots):
        return log
    base = read_latest(spark, snapshots)
    upto = base.agg(F.max("batch_id")).first()[0]
    return base.unionByName(log.where(F.col("batch_id") > upto)) if upto is not None else log


def latest_first_last(spark: SparkSession, sink_dir: str, by: str = "post_id", snapshots: str | None = None) -> DataFrame:
    """The current first/last reply per post from the upsert log of I4."""
    return _newest(_log(spark, sink_dir, by, snapshots), by).drop("batch_id")


def compact_first_last(spark: SparkSession, sink_dir: str, snapshots: str, by: str = "post_id") -> str:
    """Write the newest row of every key as a new snapshot version; later reads take it and only the
    batches that came after. Batch folders up to it are no longer needed."""
    return snapshot_then_replace(_newest(_log(spark, sink_dir, by, snapshots), by), snapshots)
