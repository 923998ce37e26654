"""Incremental runs with Structured Streaming."""

import os

from pyspark.sql import functions as F

from threadscope.streaming import incremental as I


def test_ingest_twice_sees_only_new_files(spark, tmp_dir):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "event_type", "value")
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    e.where("event_type in ('view', 'click')").write.parquet(os.path.join(src, "part1"))
    I.ingest_new_files(spark, src + "/*", sink, ck, e.schema)
    first = spark.read.parquet(sink).count()
    I.ingest_new_files(spark, src + "/*", sink, ck, e.schema)  # nothing new
    assert spark.read.parquet(sink).count() == first
    e.where("event_type not in ('view', 'click')").write.parquet(os.path.join(src, "part2"))
    I.ingest_new_files(spark, src + "/*", sink, ck, e.schema)
    back = spark.read.parquet(sink)
    assert back.count() == e.count() and back.exceptAll(e).count() == 0


def test_dedupe_stream_across_runs(spark, tmp_dir):
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    schema = "name string"
    spark.createDataFrame([("ALS",), ("als",), ("SMA",)], schema).write.parquet(os.path.join(src, "a"))
    I.ingest_new_files(spark, src + "/*", sink, ck, spark.createDataFrame([], schema).schema,
                       transform=lambda s: I.dedupe_stream(s, "name"))
    spark.createDataFrame([("Als",), ("CF",)], schema).write.parquet(os.path.join(src, "b"))
    I.ingest_new_files(spark, src + "/*", sink, ck, spark.createDataFrame([], schema).schema,
                       transform=lambda s: I.dedupe_stream(s, "name"))
    got = sorted(r[0].lower() for r in spark.read.parquet(sink).collect())
    assert got == ["als", "cf", "sma"]


def test_first_last_stream_equals_batch(spark, tmp_dir):
    li = (spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
          .select(F.col("l_orderkey").alias("post_id"), F.unix_timestamp("l_shipdate").alias("created_utc")))
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    cut = li.agg(F.expr("percentile_approx(created_utc, 0.5)")).first()[0]
    li.where(F.col("created_utc") < cut).write.parquet(os.path.join(src, "a"))
    I.first_last_reply_stream(spark, src + "/*", li.schema, sink, ck)
    li.where(F.col("created_utc") >= cut).write.parquet(os.path.join(src, "b"))  # later comments of known posts
    I.first_last_reply_stream(spark, src + "/*", li.schema, sink, ck)
    got = I.latest_first_last(spark, sink)
    snaps = str(tmp_dir) + "/snaps"
    I.compact_first_last(spark, sink, snaps)
    assert sorted(I.latest_first_last(spark, sink, snapshots=snaps).collect()) == sorted(got.collect())
    want = li.groupBy("post_id").agg(F.min("created_utc").alias("first_comment_utc"),
                                     F.max("created_utc").alias("last_comment_utc"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_label_incremental_skips_done(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(2,)], "id long")
    out = I.label_incremental(df, done, ["id"], lambda d: d.withColumn("labels", F.lit("x")))
    assert sorted(r["id"] for r in out.collect()) == [1, 3]


def test_dedupe_stream_within_watermark(spark, tmp_dir):
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    schema = "name string, ts timestamp"
    rows = [("ALS", "2024-01-01 00:00:00"), ("als", "2024-01-01 00:05:00"), ("SMA", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "name string, t string").select("name", F.col("t").cast("timestamp").alias("ts")) \
        .write.parquet(os.path.join(src, "a"))
    I.ingest_new_files(spark, src + "/*", sink, ck, spark.createDataFrame([], schema).schema,
                       transform=lambda s: I.dedupe_stream(s, "name", event_time="ts", delay="1 hour"))
    assert sorted(r[0].lower() for r in spark.read.parquet(sink).collect()) == ["als", "sma"]
