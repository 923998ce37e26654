"""Vocabulary matching (J1-J5, W3) and relations."""

from pyspark.sql import functions as F

from threadscope.operators import matching, relations
from tests.conftest import plan_text


def _texts(spark, rows):
    return spark.createDataFrame(rows, "id long, txt string")


def _terms(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def test_match_terms_is_deterministic_and_drops_unmatched(spark):
    texts = _texts(spark, [(1, "Living with ALS and SMA"), (2, "nothing here"), (3, "also Also")])
    terms = _terms(spark, ["als", "sma", "Living with", "  ", "", None])
    got = {r["id"]: r["matched_term"] for r in matching.match_terms(texts, "txt", terms, ["id"]).collect()}
    assert got == {1: "living with", 3: "als"}  # longest wins; substring hits inside words (parity)


def test_match_terms_equals_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("text").alias("term"))
    words = bench.select(F.explode(F.split("term", " ")).alias("term")).distinct()
    vocab = bench.unionByName(words).unionByName(_terms(spark, ["de", "the", "é", "ion d", "x", "a.b", "\n"]))
    terms = sorted({r[0].lower() for r in vocab.collect()} - {""}, key=lambda t: (-len(t), t))
    want = {d: next((t for t in terms if t in x.lower()), None) for d, x in docs.collect()}
    for q in (3, 5):
        got = {r["doc_id"]: r["matched_term"] for r in matching.match_terms(docs, "text", vocab, ["doc_id"], q=q).collect()}
        assert got == {d: t for d, t in want.items() if t}


def test_no_plan_has_a_nested_loop(spark):
    texts = _texts(spark, [(1, "a b")])
    cat = spark.createDataFrame([("ALS", "als group")], "name string, public_description string")
    t = _terms(spark, ["a", "abcdefgh"])
    for df in (matching.match_terms(texts, "txt", t, ["id"]), matching.find_candidates(texts, "txt", t, ["id"]),
               matching.match_acronyms(texts, "txt", t, ["id"]), matching.lookup_with_fallback(t, cat)):
        plan = plan_text(df)
        assert not any(x in plan for x in ("NestedLoop", "Cartesian", "EvalPython"))


def test_long_word_terms_are_verified(spark):
    long = " ".join(f"w{i}" for i in range(30))
    texts = _texts(spark, [(1, f"x {long} y"), (2, long.replace("w20", "other")), (3, "W0 w1"), (4, None)])
    got = {r["id"]: r["matched_term"] for r in matching.match_words(texts, "txt", _terms(spark, [long, "w0 w1", "w29"]), ["id"]).collect()}
    assert got == {1: long, 2: "w0 w1", 3: "w0 w1"}


def test_discovery_gives_one_answer_for_any_order(spark):
    from threadscope.plans.discovery import find_communities

    rows = [("als", f"title {i % 5}", "about als", i) for i in range(40)]
    vocab = _terms(spark, ["als", "title 3"])
    answers = set()
    for seed in range(5):
        cat = spark.createDataFrame(rows, "name string, title string, public_description string, rk int").orderBy(F.rand(seed)).repartition(1 + seed)
        got = find_communities(cat, vocab, order=["matched_term", "rk"]).collect()
        answers.add(tuple((r["name"], r["matched_term"], r["rk"]) for r in got))
    assert answers == {(("als", "als", 0),)}


def test_match_words_word_boundaries(spark):
    texts = _texts(spark, [(1, "red  Widget\tbig"), (2, "redwidget"), (3, "big red")])
    got = {r["id"]: r["matched_term"] for r in
           matching.match_words(texts, "txt", _terms(spark, ["red widget", "big", "wid"]), ["id"]).collect()}
    assert got == {1: "red widget", 3: "big"}


def test_acronyms_parity_and_upper(spark):
    texts = _texts(spark, [(1, "We talk about als also"), (2, "ALS support"), (3, "also nothing")])
    vocab = _terms(spark, ["ALS", "muscle"])
    parity = {r["id"]: (r["matched_term"], r["match_kind"]) for r in
              matching.find_candidates(texts, "txt", vocab, ["id"]).collect()}
    assert parity == {1: ("als", "term"), 2: ("als", "term"), 3: ("als", "term")}
    upper = {r["id"]: (r["matched_term"], r["match_kind"]) for r in
             matching.find_candidates(texts, "txt", vocab, ["id"], acronym_case="upper",
                                      acronyms_in_substring_pass=False).collect()}
    assert upper == {2: ("ALS", "acronym")}
    empty = matching.find_candidates(texts, "txt", _terms(spark, ["muscle"]), ["id"], acronym_case="exact")
    assert empty.count() == 0  # empty acronym set is fine


def test_lookup_and_first_writer_wins(spark):
    cat = spark.createDataFrame([("ALS", 10, "als group"), ("als", 5, "dup"), ("SMAfam", 7, "sma families"),
                                 ("other", 1, "sma and als")], "name string, subscribers long, public_description string")
    terms = spark.createDataFrame([("als", 1), ("sma", 2)], "term string, term_rank int")
    exact = matching.lookup_by_name(terms, cat)
    assert sorted(r["name"] for r in exact.collect()) == ["ALS", "als"]
    w = matching.first_writer_wins(exact, "name", ["term_rank", "subscribers"])
    assert [(r["name"], r["subscribers"]) for r in w.collect()] == [("als", 5)]
    fb = matching.lookup_with_fallback(terms.select("term"), cat, relevance=[F.col("subscribers").desc()], k=1)
    got = sorted((r["matched_term"], r["name"], r["hit_kind"]) for r in fb.collect())
    assert got == [("als", "ALS", "exact"), ("als", "als", "exact"), ("sma", "SMAfam", "fallback")]


def test_relations(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "s string, k long")
    names = spark.createDataFrame([("a",), ("c",), ("c",)], "s string")
    assert sorted(r["s"] for r in relations.restrict_to(df, names, "s").collect()) == ["a", "c"]
    assert [r["k"] for r in relations.only_new(df, df.where("k < 3"), "k").collect()] == [3]
    t = relations.union_terms(names, spark.createDataFrame([("b",)], "x string"))
    assert [r["term"] for r in t.collect()] == ["a", "b", "c"]
    i = relations.intersect_keys([df, df.where("k > 1"), df.where("k < 3")], ["s", "k"])
    assert [tuple(r) for r in i.collect()] == [("b", 2)]


def _found(df):
    return {(r["id"], r["_term"]) for r in df.collect()}


def test_all_contained_terms_on_every_path(spark):
    """Parts of words, terms over blanks, blanks alone, line ends; anchors broadcast or shuffled behind the filter of cells."""
    import random

    rng = random.Random(8)
    alphabet = ["a", "b", "ab", "é", " ", "  ", "\n", "the", "c"]
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))) for i in range(300)] + [(900, None), (901, ""), (902, "   ")]
    terms = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(150)} | {"a", " ", "   ", " the ", "the ab"})
    want = {(i, t) for i, x in texts for t in terms if x is not None and t in x}
    left = _texts(spark, texts).withColumnRenamed("txt", "_text")
    vocab = _terms(spark, terms).select(F.col("term").alias("_term"))
    assert len({t for _, t in want}) > 60
    for q, most in ((5, 10 ** 6), (2, 10 ** 6), (5, 0)):
        assert _found(matching._contained(left, ["id"], vocab, q, sent_anchors=most)) == want
        top = {i: min((t for j, t in want if j == i), key=lambda t: (-len(t), t)) for i, _ in want}
        assert _found(matching._contained(left, ["id"], vocab, q, best=True, sent_anchors=most)) == set(top.items())


def test_words_are_filtered_below_the_exchange(spark):
    texts = _texts(spark, [(i, f"x rare{i} word y") for i in range(50)]).withColumnRenamed("txt", "_text")
    vocab = _terms(spark, ["a rare7 w", "rare8 word"]).select(F.col("term").alias("_term"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_text(matching._contained(texts, ["id"], vocab, 5, sent_anchors=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan[:plan.index("\n\n")]
    lines = tree.splitlines()
    semi = next(i for i, l in enumerate(lines) if "BroadcastHashJoin LeftSemi" in l)
    depth = lambda l: len(l) - len(l.lstrip(" :+-"))
    above = [l for l in lines[:semi] if depth(l) < depth(lines[semi])]
    assert any("Exchange" in l for l in above)  # the exchange to the join reads what the filter left


def test_anchors_avoid_common_words(spark):
    texts = _texts(spark, [(i, f"say the most common words {i}") for i in range(200)] + [(900, "in the seldom common case")]).withColumnRenamed("txt", "_text")
    terms = matching._terms_by_part(_terms(spark, ["n the seldom common c", "y the most common w"]).select(F.col("term").alias("_term")))
    got = {r["_term"]: r["_word"] for r in matching._rarest_words(terms, texts).collect()}
    assert got["n the seldom common c"] == "seldom"


def test_lookup_does_not_depend_on_the_order_of_rows(spark):
    rows = [("als", i % 3, f"als group {i}") for i in range(40)]
    terms = _terms(spark, ["ls g"])
    answers = set()
    for seed in range(5):
        cat = spark.createDataFrame(rows, "name string, subscribers long, public_description string").orderBy(F.rand(seed)).repartition(1 + seed)
        got = matching.lookup_with_fallback(terms, cat, relevance=[F.col("subscribers").desc()])
        answers.add(tuple(r["public_description"] for r in got.orderBy("hit_rank").collect()))
    assert len(answers) == 1 and len(answers.pop()) == 3
