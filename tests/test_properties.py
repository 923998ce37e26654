"""Property checks from the test strategy: match + unmatched = input, consensus within the votes,
verdict counts, small helpers."""

from hypothesis import given, settings
from hypothesis import strategies as st

from threadscope.operators import consensus, matching, relations, report

WORDS = ["als", "sma", "cf", "rare", "x", "ab c", "b"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abcslmrex ", min_size=0, max_size=12), min_size=1, max_size=30),
       st.lists(st.sampled_from(WORDS), min_size=1, max_size=5))
def test_matched_plus_unmatched_is_input(spark, texts, terms):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, txt string")
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    hit = matching.match_terms(df, "txt", vocab, ["id"])
    miss = df.join(hit.select("id"), "id", "left_anti")
    assert hit.count() + miss.count() == len(texts)
    want = {i for i, t in enumerate(texts) if any(w in t.lower() for w in terms)}
    assert {r["id"] for r in hit.collect()} == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from("ABC"), st.lists(st.sampled_from("pqrs"), max_size=3)),
                min_size=1, max_size=40))
def test_consensus_is_within_votes(spark, rows):
    data = [(str(k), m, ";".join(v)) for k, m, v in rows]
    long = spark.createDataFrame(data, "post_id string, model string, labels string")
    out = {r["post_id"]: r["consensus_labels"] for r in consensus.consensus_labels(long, ["post_id"], 3).collect()}
    for k, lab in out.items():
        votes = [x for kk, _, v in rows if str(kk) == k for x in v]
        assert all(votes.count(x) >= 2 for x in lab.split(";") if x)
        assert {m for kk, m, _ in rows if str(kk) == k} == {"A", "B", "C"}


def test_verdict_counts_and_helpers(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("yes",), ("error",)], "gpt_label string")
    assert tuple(report.verdict_counts(df).first()) == (4, 2)
    assert sorted(tuple(r) for r in report.verdict_breakdown(df, "gpt_label").collect()) == [
        ("error", 1), ("no", 1), ("yes", 2)]
    t = spark.createDataFrame([(" b",), ("a",), ("",), ("b",), ("B",)], "term string")
    assert [r[0] for r in relations.sorted_terms(relations.distinct_terms(t)).collect()] == ["B", "a", "b"]
    w = consensus.select_labels_only(spark.createDataFrame([("s", "1", "a")], "subreddit string, post_id string, "
                                                           "labels string"), ["subreddit", "post_id"], "gpt")
    assert w.columns == ["subreddit", "post_id", "gpt"]
