import random
import re

from tests.llm import hostile
from threadscope.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items, least=13):
    """Items that some diagonal holds: the best segment by +1 / -4 has enough words. A seed must hit it
    too: some mask agrees at a place inside."""
    w, out = words(text), set()
    for i, t in items:
        b = words(t)
        if i is None or len(b) < decontam.MIN_ITEM_WORDS:
            continue
        masks = decontam.MASKS if len(b) >= 12 else ("1" * len(b),)
        for begin in range(-len(b) + 1, len(w)):
            same = [0 <= begin + j < len(w) and w[begin + j] == b[j] for j in range(len(b))]
            hit = any(all(same[p + k] for k, c in enumerate(m) if c == "1") for m in masks for p in range(len(b) - len(m) + 1))
            best, score, start, span = 0, 0, 0, 0
            for j in range(len(b)):
                if not 0 <= begin + j < len(w):
                    score = -1
                    continue
                if score <= 0:
                    score, start = 0, j
                score += 1 if same[j] else decontam.SUBSTITUTION
                if score > best:
                    best, span = score, j + 1 - start
            if hit and span >= min(least, len(b)):
                out.add(i)
    return out


def sample():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([5, 8, 11, 12, 13, 20, 35, 59, 4, 1])]
    docs = []
    for i, (_, t) in enumerate(items):
        for changes in (0, 1, 2, 6):
            w = t.split()
            for k in rng.sample(range(len(w)), min(changes, len(w))):
                w[k] = "changed"
            cut = w if changes != 6 else w[:max(1, len(w) // 2)]
            docs.append((len(docs), " ".join([*(rng.choice(vocab) for _ in range(30)), *(x.upper() + "," for x in cut), "end", "x y z"])))
    docs += [(1000 + k, " ".join(rng.choice(vocab) for _ in range(200))) for k in range(10)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = sample()
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert found == {i: b for i, t in docs if (b := brute(t, items))}
    by_item = dict(items)
    for r in got:
        mine, theirs = words(dict(docs)[r["doc_id"]]), words(by_item[r["item_id"]])
        a, b = mine[r["first_word"]:][:r["n_words"]], theirs[r["item_word"]:][:r["n_words"]]
        assert sum(x == y for x, y in zip(a, b)) == r["n_matched"] > 0.8 * r["n_words"]


def test_many_blocks_give_the_same(spark, monkeypatch):
    docs, items = sample()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(decontam.overlaps(d, b).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20)
    assert sorted(decontam.overlaps(d, b).collect()) == one


def test_hostile_rows(spark):
    items = [(1, hostile.rows()[0][1]), (2, None), (None, hostile.rows()[3][1]), (3, ""), (4, "one two three"), (1, hostile.rows()[0][1])]
    b = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, doc_id long, block int")
    docs = hostile.docs(spark)
    got = decontam.contamination(docs, b).collect()
    assert len(got) == len(hostile.rows())
    assert {r["doc_id"] for r in got if r["contaminated"]} == {1, 2, 3, None}
    assert sum(r["contaminated"] for r in got) == 4 and all(r["item_id"] == 1 for r in got if r["contaminated"])
    assert decontam.without_benchmark(docs, b).count() == len(got) - 4
    assert decontam.contamination(hostile.empty(spark), b).count() == 0
    assert not any(r["contaminated"] for r in decontam.contamination(docs, b.where("item_id = 99")).collect())


def agreeing(text, item):
    """The most words of ``item`` that agree along any diagonal: knows neither masks, seeds nor segments."""
    w, b = words(text), words(item)
    return max(sum(0 <= x + j < len(w) and w[x + j] == b[j] for j in range(len(b))) for x in range(-len(b) + 1, len(w)))


def test_items_quoted_whole_with_changed_words(spark):
    rng = random.Random(9)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (5, 7, 9, 10, 11, 12, 13, 15, 16, 17, 20, 25, 26, 40)]
    docs = []
    for n, t in items:
        w = t.split()
        changes = [(k,) for k in range(n)] + [tuple(sorted(rng.sample(range(n), c))) for c in range(2, n // 5 + 2) for _ in range(20)]
        for places in changes:
            docs.append((len(docs), " ".join(["a b c", *("x" if k in places else v for k, v in enumerate(w)), "d e"])))
        docs += [(len(docs), " ".join(w[n // 5:])), (len(docs) + 1, " ".join(w[:n - n // 5]))]  # cut at an end of the text
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(d, b).collect()}
    for i, t in docs:
        whole = [n for n, item in items if 5 * agreeing(t, item) >= 4 * n]
        assert not whole or got[i]["contaminated"] and [got[i]["item_id"]] == whole, t
        # longer items may also be found by a part of 13 words
        assert got[i]["contaminated"] == bool(whole) or got[i]["item_id"] > 13, t
    assert {r["doc_id"] for r in decontam.without_benchmark(d, b).collect()} == {i for i, r in got.items() if not r["contaminated"]}


def test_items_without_id(spark):
    text = "one two three four five six seven"
    b = spark.createDataFrame([(None, text), (None, "other " + text), (3, text)], "item_id long, text string")
    d = spark.createDataFrame([(1, text), (2, "none of those words")], "doc_id long, text string")
    for items, n, item in ((b, 2, 3), (b.where("item_id is null"), 1, None)):
        got = {r["doc_id"]: r for r in decontam.contamination(d, items, unnamed=True).collect()}
        assert (got[1]["contaminated"], got[1]["n_items"], got[1]["item_id"]) == (True, n, item) and not got[2]["contaminated"]
        assert [r["doc_id"] for r in decontam.without_benchmark(d, items, unnamed=True).collect()] == [2]


def test_repeated_items_are_sent_once(spark, monkeypatch):
    """300 repeats of one item beside others: one text in one block, and still an overlap for each of its ids."""
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[:30])
    items = [(i, item) for i in range(300)] + [(1000 + i, " ".join(words[40 + 9 * i:70 + 9 * i])) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, "nothing of it")], "doc_id long, text string")
    sent = []
    keep = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or keep(x))
    found = decontam.overlaps(docs, bench, whole=True).collect()
    assert sorted({r["item_id"] for r in found}) == list(range(300)) and {r["doc_id"] for r in found} == {1}
    texts = [t for x in sent if isinstance(x, tuple) and len(x) == 4 for t in x[1]]
    assert len(texts) == len(set(texts)) == 31
