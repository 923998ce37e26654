"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare.

Comparison: same column names (sorted), same row count, and the same multiset of
rows after normalising values (floats rounded to 6 places, NaN -> None).

    python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, key: str, sf_dir: str):
    from threadscope.plans.oracle import ORACLE
    from threadscope.plans.queries import QUERIES

    t0 = time.time()
    sdf = QUERIES[key](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(ORACLE[key])
    d_cols = rel.columns
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, first: {diff}")
    return problems, len(s_rows), t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    from threadscope.plans.queries import QUERIES
    from threadscope.session import build_session

    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for key in keys or list(QUERIES):
        try:
            problems, n, secs = compare(spark, con, key, sf_dir)
        except Exception as exc:  # noqa: BLE001
            problems, n, secs = [f"error {type(exc).__name__}: {str(exc)[:600]}"], -1, 0.0
        status = "OK  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{status} {key:28s} rows={n:7d} {secs:6.2f}s {'; '.join(problems)}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
