"""Durable and paced model calls."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from threadscope.operators import batch, call_log

HERE = os.path.dirname(os.path.abspath(__file__))


@pytest.mark.parametrize("rate", ["0", "1000"])
def test_no_prompt_is_asked_twice_after_a_task_died(tmp_dir, rate):
    subprocess.run([sys.executable, os.path.join(HERE, "call_app.py"), tmp_dir, rate], check=True, capture_output=True, timeout=300)
    assert os.path.exists(f"{tmp_dir}/died")
    asked = open(f"{tmp_dir}/asked").read().splitlines()
    assert sorted(asked) == sorted(f"prompt {i}" for i in range(100))


def test_failed_prompts_are_asked_again_by_a_later_run(spark, tmp_dir):
    log = f"{tmp_dir}/log"
    df = spark.createDataFrame([(i, None if i == 3 else f"p{i % 7}") for i in range(20)], "id long, p string")

    def broken(prompts):
        if "p5" in prompts:
            raise RuntimeError("down")
        return [p + "!" for p in prompts]

    def run(fn):
        got = batch.run_batches(df, F.col("p"), fn, batch_size=4, policy=batch.RetryPolicy(2, 0.0), partitions=2, log=log).collect()
        return {(r["id"], r["reply"], r["reply_error"]) for r in got}

    text = lambda i: "" if i == 3 else f"p{i % 7}"
    assert run(broken) == {(i, None if text(i) == "p5" else text(i) + "!", "RuntimeError: down" if text(i) == "p5" else None) for i in range(20)}
    # only p5 is asked; the other replies stay those of the first run
    assert run(lambda prompts: [p + "?" for p in prompts]) == {(i, text(i) + ("?" if text(i) == "p5" else "!"), None) for i in range(20)}


def test_a_half_written_file_is_not_read(tmp_dir):
    log = call_log.CallLog(tmp_dir).of_partition(0)
    log.add({"d": "reply"})
    with open(f"{log.path}/_half", "w") as f:
        f.write('{"digest": "e", "rep')
    assert call_log.PartitionLog(log.path).replies == {"d": "reply"}


def test_rate_holds_over_all_tasks(spark, tmp_dir):
    rate, notes = 20.0, f"{tmp_dir}/times"

    def model(prompts):
        with open(notes, "a") as f:
            f.write(f"{time.time()}\n")
        if prompts[0].endswith("3"):
            raise RuntimeError("tries count too")
        return ["ok"] * len(prompts)

    df = spark.range(40).select("id", F.concat(F.lit("p"), "id").alias("p"))
    out = batch.run_batches(df, F.col("p"), model, batch_size=1, policy=batch.RetryPolicy(2, 0.0, rate=rate), partitions=4)
    assert out.where("reply = 'ok'").count() == 36 and out.where("reply_error like '%tries%'").count() == 4
    at = sorted(float(x) for x in open(notes))
    assert len(at) == 44  # 36, and 4 twice
    assert all(sum(a <= t < a + 1 for t in at) <= rate * 1.15 + 1 for a in at)


def test_pacer_counts_from_the_last_call():
    pacer = call_log.Pacer(0.05)
    begin = time.monotonic()
    for _ in range(4):
        pacer.wait()
    assert time.monotonic() - begin >= 0.14
