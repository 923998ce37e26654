"""Write PLANS.md: the physical plan (explain "simple") of the main registered queries at sf0.01.

    python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = {
    "high_signal_events": "W1: partial WindowGroupLimit before the exchange; group sizes from a partial aggregate",
    "term_match": "J1: character runs joined to one anchor per term, pairs verified; best term via row_number with group limit",
    "term_match_qgram": "J1: the same plan with a vocabulary of passages and words",
    "term_match_words": "J2: word n-grams of occurring lengths equi-joined to the vocabulary",
    "keep_first": "W2: row_number() <= 1 with partial WindowGroupLimit",
    "label_consensus": "J7 + A5: one shuffle on the keys, votes counted inside each key's group",
    "latency_by_label": "A4: exact quantiles from (label, value) ranges with offsets",
    "since_date": "F1: literal of the column's own type -> PushedFilters; ReadSchema pruned",
    "min_length": "X4 + F3: cleaned text evaluated once, after spreading the single-split input",
    "fastest_20": "W5: TakeOrderedAndProject",
    "restrict_to": "J10: semi join, strategy left to the planner",
    "first_last_reply": "A1 + J6: comments reduced to one row per post before the left join",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from threadscope.plans.queries import QUERIES
    from threadscope.session import build_session

    spark = build_session()
    out = ["# Physical plans of the main queries",
           "",
           f"Generated by `tools/dump_plans.py` at `{sf_dir}` (AQE shows the initial plan; long regex",
           "literals are shortened).", ""]
    for key, note in KEYS.items():
        df = QUERIES[key](spark, sf_dir)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        plan = re.sub(r"#\d+L?", "", plan)
        plan = re.sub(r"\[\\t-\\r[^\]]*\]", "[WS]", plan)
        plan = "\n".join(line[:220] for line in plan.splitlines() if line.strip())
        out += [f"## `{key}`", "", note, "", "```", plan, "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
