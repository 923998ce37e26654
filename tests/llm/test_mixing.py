import math
from collections import defaultdict

import pytest

from tests.llm import hostile
from threadscope.llm import mixing


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by rounds: share by weight, stop at the caps, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and free:
        unit = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += unit * w[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def check(rows, got):
    size_of = lambda t: len((t or "").encode().split())
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
        longest[s] = max(longest[s], size_of(t))
    target, taken = water(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert r["copies"] - math.floor(r["target"] / max(r["source_size"], 1) + 1e-9) in (0, 1) or not r["source_size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1


def test_hostile_rows(spark):
    rows = [(r[0], r[1], r[3]) for r in hostile.rows()]
    check(rows, mixing.mix(mixing.measure(hostile.docs(spark))).collect())
    assert mixing.mix(mixing.measure(hostile.empty(spark))).count() == 0


def test_hot_source_small_sources_and_reruns(spark):
    rows = [(i, "w " * (1 + i * 7919 % 60), None if i % 97 == 0 else "hot" if i % 3 else f"s{i % 40:02d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(mixing.measure(df)).collect()
    check(rows, got)
    again = mixing.mix(mixing.measure(df.repartition(9))).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_words_of_all_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, " \n", None)], "doc_id long, text string, source string")
    got = mixing.mix(mixing.measure(df)).collect()
    assert [r["taken"] for r in got] == [0, 0, 0] and {r["target"] for r in got} == {0.0}


def test_heavier_documents_come_earlier(spark):
    """Half the words of one source: letters-only texts are taken more often than texts of digits."""
    rows = [(i, ("abcde " if i % 2 else "12345 ") * 10, "a" if i < 2000 else "b" if i < 12000 else "c") for i in range(14000)]
    got = mixing.mix(mixing.measure(spark.createDataFrame(rows, "doc_id long, text string, source string")),
                     weights=(1, 1, 1)).where("source = 'b'").collect()
    share = {k: sum(r["copies"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1)}
    assert share[1] > 2 * share[0] > 0


def test_mixed_rows_are_whole_and_repeat(spark):
    docs = hostile.docs(spark)
    plan = {}
    for r in mixing.mix(mixing.measure(docs)).collect():
        k = (r["doc_id"], r["source"], r["size"])
        plan[k] = plan.get(k, 0) + r["copies"]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    seen = {}
    for r in mixed.collect():
        k = (r["doc_id"], r["source"], len((r["text"] or "").encode().split()))
        seen[k] = seen.get(k, 0) + 1
    assert seen == {k: n for k, n in plan.items() if n}


def test_ranges_spread_whatever_the_script(spark):
    """4,000 texts almost without ASCII letters beside 4,000 of nothing else, in one source."""
    rows = [(i, "日本語 の 文書 " * 9 if i % 2 else "plain letters here " * 9, "s") for i in range(8000)]
    measured = mixing.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    ranged = measured.withColumn("key", mixing.sampling_key()).selectExpr("doc_id % 2 AS kind", "floor(ln(key) * 256) AS r")
    for kind in (0, 1):
        sizes = [r["count"] for r in ranged.where(f"kind = {kind}").groupBy("r").count().collect()]
        assert len(sizes) > 500 and max(sizes) < 30
    check(rows, mixing.mix(measured).collect())


def test_order_of_the_sample_is_that_of_the_keys(spark):
    """The fractional part holds the smallest keys of its source, found here by one sort."""
    rows = [(i, ("日本 " if i % 3 else "letters ") * (1 + i % 7), "a" if i < 300 else "b" if i < 2500 else "c") for i in range(4000)]
    measured = mixing.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    keys = {r["doc_id"]: r["k"] for r in measured.select("doc_id", mixing.sampling_key().alias("k")).collect()}
    got = mixing.mix(measured).collect()
    for s in "abc":
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: (keys[r["doc_id"]], r["doc_id"]))
        epochs, ahead = int(mine[0]["target"] // mine[0]["source_size"]), 0
        wanted = mine[0]["target"] - epochs * mine[0]["source_size"]
        for r in mine:
            assert r["copies"] == epochs + (ahead + r["size"] / 2 < wanted)
            ahead += r["size"]
