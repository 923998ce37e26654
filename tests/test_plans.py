"""Plan shapes of registered queries: pushdown, pruning, join strategy, no Python UDF in the hot path."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01, plan_text
from threadscope.operators import latency, ordering
from threadscope.plans.queries import QUERIES

PURE = ["high_signal_events", "high_signal_users", "signal_audit", "drop_report", "engagement_score",
        "filter_authors", "since_date", "min_length", "nonempty_body", "clean_text", "one_line", "shorten_text",
        "render_prompt", "term_match", "term_match_words", "acronym_match", "numeric_terms", "lookup_exact",
        "lookup_fallback", "only_new", "restrict_to", "union_terms", "intersect_keys", "first_last_reply",
        "reply_latency", "fastest_20", "slowest_20", "latency_by_label", "label_consensus", "consensus_attached",
        "annotated_posts", "label_summary", "label_frequency", "label_parse_strict", "label_parse_first_object",
        "label_parse_fallback", "fenced_verdict", "kept_names", "keyword_verdict", "keep_first", "duplicate_rows",
        "preprocess_posts"]


@pytest.mark.parametrize("key", PURE)
def test_no_python_udf(spark, key):
    plan = plan_text(QUERIES[key](spark, SF01))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan


def test_expected_operators(spark):
    for key in ("term_match", "term_match_qgram", "acronym_match", "lookup_fallback", "discovery_lookup"):
        p = plan_text(QUERIES[key](spark, SF01))
        assert "BroadcastHashJoin" in p and "NestedLoop" not in p
    assert "LeftSemi" in plan_text(QUERIES["restrict_to"](spark, SF01))
    p = plan_text(QUERIES["high_signal_events"](spark, SF01))
    assert p.index("WindowGroupLimit") < p.rindex("Exchange") or "Partial" in p
    p = plan_text(QUERIES["since_date"](spark, SF01))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p
    p = plan_text(QUERIES["preprocess_posts"](spark, SF01))
    assert "GreaterThanOrEqual(o_orderdate" in p
    p = plan_text(QUERIES["fastest_20"](spark, SF01))
    assert "TakeOrderedAndProject" in p
    p = plan_text(QUERIES["keep_first"](spark, SF01))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_label_batch_uses_arrow_batches(spark):
    p = plan_text(QUERIES["label_batch"](spark, SF01))
    assert "ArrowEvalPython" in p and "MapInPandas" not in p and "BatchEvalPython" not in p


def test_yield_curve_matches_running_count(spark):
    lab = spark.read.parquet(f"{SF01}/labels.parquet")
    got = [tuple(r) for r in ordering.yield_curve(lab, F.col("quality") == 1, ["doc_id"], 50)
           .orderBy("processed").collect()]
    rows = sorted((r["doc_id"], r["quality"]) for r in lab.collect())
    want, pos = [], 0
    for i, (_, q) in enumerate(rows, 1):
        pos += q == 1
        if i % 50 == 0 or i == len(rows):
            want.append((i, pos))
    assert got == want


def test_latency_rank_and_preview(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(40)], "post_id long, latency_min double")
    fast = [r["post_id"] for r in latency.latency_rank(df, 3).collect()]
    assert fast == [7, 14, 21]
    slow = [r["post_id"] for r in latency.latency_rank(df, 2, fastest=False).collect()]
    assert slow == [6, 13]
    assert [r["post_id"] for r in ordering.preview(df, ["post_id"], 2).collect()] == [0, 1]


def test_write_clean_partitions(spark, tmp_dir):
    import os

    from threadscope.sources.sinks import write_clean

    df = spark.createDataFrame([("a", 1), ("b", 2)], "subreddit string, x int")
    write_clean(df, os.path.join(tmp_dir, "clean"))
    back = spark.read.parquet(os.path.join(tmp_dir, "clean"))
    assert sorted(tuple(r) for r in back.select("subreddit", "x").collect()) == [("a", 1), ("b", 2)]


def test_top_k_per_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "g string, v int")
    out = sorted(tuple(r) for r in ordering.top_k_per_group(df, "g", [F.col("v").desc()], 2).collect())
    assert out == [("a", 2, 2), ("a", 3, 1), ("b", 5, 1)]
