"""High-signal sampling (W1/F9/A2/A9) against a pandas statement of the rule, plus plan shape."""

import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadscope.operators import sampling
from tests.conftest import plan_text


def py_sample(pdf, pct=10, cap=20, min_rows=10):
    out = []
    for _, g in pdf.groupby("g"):
        if len(g) < min_rows:
            continue
        n = min(cap, max(1, math.ceil(len(g) * pct / 100)))
        out.append(g.sort_values(["s", "id"], ascending=[False, True]).head(n))
    return pd.concat(out) if out else pdf.iloc[0:0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-3, 3)), min_size=0, max_size=300))
def test_top_percent_capped_matches_pandas(spark, rows):
    pdf = pd.DataFrame([(g, float(s), i) for i, (g, s) in enumerate(rows)], columns=["g", "s", "id"])
    df = spark.createDataFrame(pdf, "g long, s double, id long") if len(pdf) else \
        spark.createDataFrame([], "g long, s double, id long")
    got = sorted(r["id"] for r in sampling.top_percent_capped(df, "g", "s", ["id"], 10, 5, 3).collect())
    want = sorted(py_sample(pdf, 10, 5, 3)["id"].tolist()) if len(pdf) else []
    assert got == want


def test_ties_at_the_cut_use_the_tiebreak(spark):
    rows = [("c", 1.0, i) for i in range(30)]  # 30 rows, all equal scores -> keep 3 smallest ids
    df = spark.createDataFrame(rows, "g string, s double, id long")
    got = sorted(r["id"] for r in sampling.top_percent_capped(df, "g", "s", ["id"]).collect())
    assert got == [0, 1, 2]


def test_defaults_and_engagement(spark):
    df = spark.createDataFrame([(1, None, None)], "id long, score double, num_comments long")
    r = sampling.with_engagement(sampling.with_defaults(df, {"score": 0, "total_awards": 0})).first()
    assert r["engagement"] == 0.0 and r["score"] == 0
    df2 = spark.createDataFrame([(2.0, 3, 1)], "score double, num_comments long, total_awards long")
    assert abs(sampling.with_engagement(df2).first()["engagement"] - (2 + math.log(4) + 2)) < 1e-12


def test_plan_limits_before_shuffle(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("s", F.col("value"))
    plan = plan_text(sampling.top_percent_capped(e, "event_type", "s", ["event_id"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_drop_report_and_counts(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "g string, k boolean")
    r = sampling.drop_report(df, F.col("k"), "g").first().asDict()
    assert r == {"rows_before": 3, "rows_after": 1, "rows_dropped": 2, "groups_before": 2, "groups_after": 1,
                 "groups_dropped": 1}
    assert [tuple(x) for x in sampling.group_counts(df, "g").collect()] == [("a", 2), ("b", 1)]
