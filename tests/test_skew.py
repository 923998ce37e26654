"""Skew: a key holding a third of the rows must not reach one task whole.

Runs ``skew_app.py`` in its own Spark application with the event log written to a
temporary folder, then reads per-task shuffle-read record counts from the log.
"""

import glob
import json
import os
import subprocess
import sys

HERE = os.path.dirname(os.path.abspath(__file__))


def _task_reads(log_dir):
    files = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(p) and not os.path.basename(p).startswith(("appstatus", "."))]
    stage_group, reads = {}, {}
    lines = [line for p in sorted(files) for line in open(p) if line.startswith("{")]
    for line in lines:
        ev = json.loads(line)
        if ev["Event"] == "SparkListenerStageSubmitted":
            props = ev.get("Properties") or {}
            stage_group[ev["Stage Info"]["Stage ID"]] = props.get("spark.jobGroup.id")
        elif ev["Event"] == "SparkListenerTaskEnd":
            m = ev.get("Task Metrics") or {}
            sr = m.get("Shuffle Read Metrics") or {}
            recs = sr.get("Total Records Read", 0)
            group = stage_group.get(ev["Stage ID"])
            if recs and group:
                reads.setdefault(group, []).append(recs)
    return reads


def test_hot_key_is_reduced_before_the_shuffle(tmp_path):
    log_dir = str(tmp_path / "events")
    os.makedirs(log_dir)
    subprocess.run([sys.executable, os.path.join(HERE, "skew_app.py"), log_dir, "/root/testdata/sf0.01"],
                   check=True, capture_output=True, timeout=600)
    reads = _task_reads(log_dir)
    # the hot key holds ~17,000 of 60,000 rows (line numbers 1-2); the other rows form ~100
    # supplier groups. Round-robin spreading reads 7,500 rows per task.
    # At most cap (20) rows per group leave each of the 8 map tasks
    assert max(reads["w1"]) <= 7500
    # One row per key per map task
    assert max(reads["w2"]) <= 7500
    # F9 sizes: partial aggregation, one row per key per map task
    assert max(reads["f9"]) <= 7500
    # after the shuffle no task reads anything close to the hot key's rows
    final = sorted(r for g in ("w1", "w2", "f9") for r in reads[g] if r != 7500)
    assert final and max(final) < 17000 / 4, final[-5:]
