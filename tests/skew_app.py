"""A small Spark application run by test_skew.py with the event log on: skewed inputs
through the skew-sensitive operators. Prints nothing; the test reads the event log."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from threadscope.operators import consensus, filters, sampling  # noqa: E402

log_dir, sf_dir = sys.argv[1], sys.argv[2]
spark = (SparkSession.builder.master("local[4]").appName("skew")
         .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", log_dir).config("spark.eventLog.compress", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "false")  # measure the plans themselves, not AQE rescue
         .config("spark.sql.autoBroadcastJoinThreshold", "-1")
         .getOrCreate())
li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(8)
# one key holds a third of all rows
hot = li.withColumn("g", F.when(F.col("l_linenumber") <= 2, F.lit("hot")).otherwise(F.col("l_suppkey").cast("string")))
spark.sparkContext.setJobGroup("w1", "w1")
sampling.top_percent_capped(hot, "g", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                            10, 20, 1).write.format("noop").mode("overwrite").save()
spark.sparkContext.setJobGroup("w2", "w2")
consensus.keep_first(hot.select("g", "l_orderkey", "l_partkey"), ["g"], ["l_orderkey", "l_partkey"]) \
    .write.format("noop").mode("overwrite").save()
spark.sparkContext.setJobGroup("f9", "f9")
filters.group_sizes(hot, ["g"]).write.format("noop").mode("overwrite").save()
spark.stop()
