"""A small Spark application run by test_call_log.py: a task dies in the middle and is retried. Every prompt that
the model is asked is noted in a file."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from threadscope.operators import batch  # noqa: E402

folder, rate = sys.argv[1], float(sys.argv[2])
spark = (SparkSession.builder.master("local[2,4]").appName("calls").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", f"{folder}/checkpoints").getOrCreate())


def model(prompts):
    if "prompt 57" in prompts and not os.path.exists(f"{folder}/died"):
        open(f"{folder}/died", "w").close()
        os._exit(1)  # the Python worker is gone, with it the task
    with open(f"{folder}/asked", "a") as f:
        f.write("".join(p + "\n" for p in prompts))
    return [p.upper() for p in prompts]


df = spark.range(100).select("id", F.concat(F.lit("prompt "), "id").alias("p")).repartition(2)
out = batch.run_batches(df, F.col("p"), model, batch_size=3, policy=batch.RetryPolicy(1, 0.0, rate=rate or None), partitions=2, log=f"{folder}/log")
rows = sorted(tuple(r) for r in out.select("id", "p", "reply", "reply_error").collect())
assert rows == [(i, f"prompt {i}", f"PROMPT {i}", None) for i in range(100)], rows[:5]
# a second run finds every reply in the log
again = batch.run_batches(df, F.col("p"), model, policy=batch.RetryPolicy(1, 0.0, rate=rate or None), partitions=2, log=f"{folder}/log")
assert sorted(tuple(r) for r in again.select("id", "p", "reply", "reply_error").collect()) == rows
spark.stop()
