"""Tree flattening (G1), flat unification (G2) and batch inference."""

import json

from pyspark.sql import functions as F

from threadscope.operators import batch, threads


def _chain(post_id, depth):
    node = None
    for i in range(depth, 0, -1):
        parent = f"t3_{post_id}" if i == 1 else f"t1_c{i - 1}"
        node = {"id": f"c{i}", "parent_id": parent, "created_utc": 100 + i, "body": f"reply\n{i}",
                "replies": [node] if node else []}
    return {"subreddit": "s", "id": post_id, "created_utc": 100, "title": "t", "selftext": None,
            "comments": [node] if node else []}


def test_flatten_deep_chain_and_bushy_tree(spark):
    bushy = {"subreddit": "s", "id": "p2", "created_utc": 5, "author": "op", "selftext": "body\nline ",
             "comments": [{"id": "a", "parent_id": "t3_p2", "created_utc": 6, "author": None,
                           "replies": [{"id": "b", "parent_id": "t1_a", "created_utc": 7, "score": 3}]},
                          {"id": "c", "parent_id": "t3_p2", "created_utc": 8}]}
    lines = [json.dumps(_chain("p1", 120)), json.dumps(bushy)]
    df = spark.createDataFrame([(x,) for x in lines], "value string").select(F.parse_json("value").alias("thread"))
    rows = threads.flatten_threads(df).collect()
    assert len(rows) == (1 + 120) + (1 + 3)
    by_id = {(r["post_id"], r["comment_id"]): r for r in rows}
    post = by_id[("p2", "")]
    assert (post["parent_id"], post["is_post"], post["body"], post["author"]) == ("t3_p2", True, "body line", "op")
    assert by_id[("p2", "a")]["author"] == "[deleted]" and by_id[("p2", "b")]["score"] == 3
    assert by_id[("p1", "c120")]["parent_id"] == "t1_c119" and by_id[("p1", "c120")]["body"] == "reply 120"
    assert by_id[("p1", "")]["body"] == ""  # null selftext -> ''


def test_unify_flat_objects_resolves_roots(spark):
    objs = [(True, "s", "p", None, "op", 1, 1, 2, "post body"),
            (False, "s", "c1", "t3_p", "u", 2, 0, None, "x"),
            (False, "s", "c2", "t1_c1", "u", 3, 0, None, "y")]
    objs += [(False, "s", f"d{i}", "t1_c2" if i == 0 else f"t1_d{i - 1}", "u", 4 + i, 0, None, "z") for i in range(40)]
    objs += [(False, "s", "orphan", "t1_missing", "u", 9, 0, None, "o"), (None, "s", "q", None, None, 1, None, None, None)]
    df = spark.createDataFrame(objs, "is_post boolean, subreddit string, id string, parent_id string, author string, "
                                     "created_utc long, score long, num_comments long, body string")
    out = {(r["post_id"], r["comment_id"]): r for r in threads.unify_flat_objects(df).collect()}
    assert out[("p", "d39")]["parent_id"] == "t1_d38"
    assert out[(None, "orphan")]["is_post"] is False
    assert out[("q", "")]["author"] == "[deleted]" and out[("q", "")]["body"] == ""
    assert len(out) == 1 + 2 + 40 + 1 + 1


def test_projections(spark):
    df = spark.createDataFrame([("s", "i", None, 7, None, None, "t", None, "u")],
                               "subreddit string, id string, author string, created_utc long, score long, "
                               "num_comments long, title string, selftext string, url string")
    p = threads.project_submission(df).first()
    assert (p["is_post"], p["author"], p["body"], p["score"], p["num_comments"]) == (True, "[deleted]", "", 0, 0)
    c = threads.project_comment(df.withColumn("parent_id", F.lit("t3_x")).withColumn("body", F.lit(None))).first()
    assert (c["is_post"], c["body"], c["parent_id"]) == (False, "", "t3_x")


def test_label_posts_retries_and_keeps_failed_rows(spark, tmp_path):
    marker = tmp_path / "calls"

    def flaky(prompts):
        n = int(marker.read_text()) if marker.exists() else 0
        marker.write_text(str(n + 1))
        if n < 2:
            raise ConnectionError("transient")
        return [json.dumps({"labels": ["news", "spam"]}) for _ in prompts]

    df = spark.createDataFrame([(i, f"post {i}") for i in range(5)], "id long, body string")
    out = batch.label_posts(df, flaky, policy=batch.RetryPolicy(3, 0.01), partitions=1, batch_size=10).collect()
    assert sorted(r["labels"] for r in out) == ["news"] * 5
    assert all(r["reply_error"] is None for r in out)

    def broken(prompts):
        raise TimeoutError("down")

    bad = batch.label_posts(df, broken, policy=batch.RetryPolicy(2, 0.0), partitions=2).collect()
    assert len(bad) == 5 and all(r["labels"] is None and "TimeoutError" in r["reply_error"] for r in bad)


def test_crosscheck_asks_once_per_distinct_term(spark, tmp_path):
    seen = tmp_path / "seen"

    def fn(terms):
        with open(seen, "a") as f:
            f.write("\n".join(terms) + "\n")
        return ['```json\n{"is_rare": "yes", "prevalence": "1/5000"}\n```' if t == "als" else "nope" for t in terms]

    df = spark.createDataFrame([(1, "als"), (2, "als"), (3, "flu"), (4, None)], "id long, matched_term string")
    out = {r["id"]: (r["keep"], r["prevalence_est"]) for r in batch.crosscheck_terms(df, fn).collect()}
    assert out == {1: ("yes", "1/5000"), 2: ("yes", "1/5000"), 3: ("error", ""), 4: (None, None)}
    assert sorted(x for x in seen.read_text().split("\n") if x) == ["als", "flu"]


def test_verify_candidates_keywords(spark):
    df = spark.createDataFrame([("a",), ("b",)], "name string")
    out = batch.verify_candidates(df, lambda ps: ["rare" if "a" in p else "maybe" for p in ps],
                                  F.concat(F.lit("r/"), F.col("name")))
    assert sorted((r["name"], r["gpt_label"]) for r in out.collect()) == [("a", "yes"), ("b", "error")]


def test_roots_with_repeats_cycles_and_missing_parents(spark):
    rows = [("c1", "t3_p"), ("c1", "t3_p"), ("c2", "t1_c1"), ("c3", "t1_c2"), ("x", "t1_y"), ("y", "t1_z"), ("z", "t1_x"),
            ("self", "t1_self"), ("tail", "t1_x"), ("lost", "t1_nobody"), ("none", None), (None, "t3_p")]
    rows += [(f"d{i}", f"t1_d{i - 1}" if i else "t3_q") for i in range(300)]
    got = threads.resolve_roots(spark.createDataFrame(rows, "id string, parent_id string"))
    found = {r["id"]: r["post_id"] for r in got.collect()}
    assert got.count() == len(found) == len({i for i, _ in rows if i})
    assert {i: p for i, p in found.items() if p} == {"c1": "p", "c2": "p", "c3": "p", **{f"d{i}": "q" for i in range(300)}}


def test_unify_keeps_repeated_objects(spark):
    rows = [(True, "p", None), (False, "c1", "t3_p"), (False, "c1", "t3_p"), *[(False, f"c{i}", f"t1_c{i - 1}") for i in range(2, 6)]]
    df = spark.createDataFrame([(a, "s", b, c, "u", 1, 1, "x") for a, b, c in rows],
                               "is_post boolean, subreddit string, id string, parent_id string, author string, created_utc long, score long, body string")
    got = sorted(r["comment_id"] for r in threads.unify_flat_objects(df).collect() if not r["is_post"])
    assert got == ["c1", "c1", "c2", "c3", "c4", "c5"]
