import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tests.llm import hostile
from threadscope.llm import ngram_join
from threadscope.llm.components import connected_components, united
from threadscope.llm.ngram_join import ngram_components, ngram_links, one_of_each

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def grams(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, n, component) of every row; rows of one id are one document."""
    sets = [(i, grams(t)) for i, t in rows]
    least = {i: i for i, _ in rows if i is not None}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            r, s = sorted((root(a), root(b)))
            least[s] = r
    return sorted(((i, len(g), None if i is None else root(i)) for i, g in sets), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_hostile_rows(spark):
    assert found(ngram_components(hostile.docs(spark))) == brute([r[:2] for r in hostile.rows()])


def test_empty_table(spark):
    df = ngram_components(hostile.empty(spark))
    assert df.count() == 0 and df.columns[:3] == ["doc_id", "n_shingles", "component_id"]


def test_families_of_near_copies(spark):
    """Chains of edits, where only neighbours link, and families larger than the neighbours looked at."""
    rng = random.Random(11)
    rows, i = [], 0
    for family in range(12):
        words = [f"f{family}x{k}" for k in range(80)]
        for step in range(rng.choice([1, 2, 5, 30])):
            if family % 2:
                words = list(words)
                words[rng.randrange(80)] = f"new{family}-{step}"
                text = words
            else:
                text = list(words)
                text[rng.randrange(80)] = f"own{family}-{step}"
            rows.append((i, " ".join(text)))
            i += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(ngram_components(df)) == brute(rows)


def test_shared_passage_alone_does_not_link(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, passage + " " + " ".join(f"u{i}-{rng.random()}" for _ in range(60))) for i in range(40)]
    got = found(ngram_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted([(i, 96, i) for i in range(40)], key=str)


def test_threshold_is_inclusive(spark):
    """8 shared of 10 different 5-grams: exactly 0.8."""
    a = [f"a{k}" for k in range(13)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:12], "z"])), (3, " ".join([*a[:11], "y", "z"]))]
    sets = {i: grams(t) for i, t in rows}
    assert (len(sets[1] & sets[2]), len(sets[1] | sets[2])) == (8, 10)
    assert found(ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_of_each_keeps_one_row_of_each_component_of_texts(spark):
    """Rows are judged by their own text; an id that repeats, or none, comes after the others."""
    rows = [r[:2] for r in hostile.rows()] + [(30, "alpha beta gamma delta epsilon zeta"), (30, "alpha beta gamma delta epsilon zeta"), (5, "an own text of the id five here"),
                                              (3, None), (3, None)]
    kept = one_of_each(hostile.docs(spark, rows))
    assert kept.columns == hostile.docs(spark).columns
    component = dict((i, c) for i, _, c in brute([(n, t) for n, (_, t) in enumerate(rows)]))
    ids = [i for i, _ in rows]
    own = lambda n: ids[n] is not None and ids.count(ids[n]) == 1
    want = []
    for c in sorted(set(component.values())):
        members = [n for n in component if component[n] == c]
        single = sorted((ids[n], n) for n in members if own(n))
        want.append([rows[single[0][1]]] if single else [rows[n] for n in members])
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(want)
    for choice in want:
        found = next(x for x in choice if x in got)
        got.remove(found)
    assert not got


def test_one_of_each_of_plain_ids(spark):
    rows = [(i, t) for i, t in dict((r[0], r[1]) for r in hostile.rows()).items() if i is not None]
    want = [i for i, _, c in brute(rows) if i == c]
    assert sorted(r["doc_id"] for r in one_of_each(hostile.docs(spark, rows)).collect()) == sorted(want)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1001 + i) for i in range(50)]
    df = spark.createDataFrame([*path, *star, (5, 5), (None, 3), (7, 6)], "a long, b long")
    want = {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(51)}}
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want
    # many small parts: the star rounds join what the parts keep apart
    df = spark.createDataFrame([(a, b) for a, b in zip(range(200), range(1, 201))][::-1] + star, "a long, b long").repartition(16)
    assert {r["node"]: r["component"] for r in connected_components(df, part=16).collect()} == want
    assert connected_components(df.where(F.lit(False))).count() == 0


def test_united_links_match_a_walk():
    rng = np.random.default_rng(5)
    for n, m in ((2, 1), (30, 20), (300, 280), (40, 400)):
        u, v = rng.integers(0, n, (2, m)) * 7 - 50
        root = {x: x for x in {*u.tolist(), *v.tolist()}}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u.tolist(), v.tolist()):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        got = dict(zip(*(x.tolist() for x in united(u, v))))
        assert got == {x: top(x) for x in root if top(x) != x}


def brute_links(rows):
    """Number of other documents that any text of a document links with."""
    out = {i: set() for i, _ in rows if i is not None}
    for (a, x), (b, y) in combinations([(i, grams(t)) for i, t in rows if i is not None], 2):
        if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y):
            out[a].add(b)
            out[b].add(a)
    return {i: len(v) for i, v in out.items()}


def links(df):
    return {(r["doc_id"], r["n_links"]) for r in df.collect()}


def test_links_of_hostile_rows(spark):
    rows = [r[:2] for r in hostile.rows()]
    got = ngram_links(hostile.docs(spark))
    assert found(got) == brute(rows)
    assert links(got) == {*brute_links(rows).items(), (None, 0)}
    assert ngram_links(hostile.empty(spark)).count() == 0


def test_links_inside_families_of_near_copies(spark, monkeypatch):
    """No link is lost in families of many different texts, copies and documents of several texts."""
    rng = random.Random(12)
    rows = []
    for family, size in enumerate((1, 2, 4, 40, 60)):
        words = [f"f{family}x{k}" for k in range(80)]
        for _ in range(size):
            text = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                text[rng.randrange(80)] = f"own{rng.random()}"
            rows += [(len(rows), " ".join(text[:rng.choice([80, 80, 70])]))]
    rows += [(rng.randrange(len(rows)), rng.choice(rows)[1]) for _ in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = set(brute_links(rows).items())
    assert links(ngram_links(df)) == want
    monkeypatch.setattr(ngram_join, "BUCKET_CLASSES", 7)
    monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    assert links(ngram_links(df)) == want
