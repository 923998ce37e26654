import random
import re

from tests.llm import hostile
from threadscope.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(text, templates=L.TEMPLATES, threshold=0.8):
    """Every window that holds enough of a template's words, without any filter."""
    w = WORD.findall((text or "").translate(FOLD))
    base = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    blocks = set()
    for t, label in templates.items():
        own = set(t.split())
        least = -(-int(round(threshold * 1000)) * len(own) // 1000)
        window = 16
        while window < 2 * len(t.split()):
            window *= 2
        for b in range(0, max(len(w), 1), window // 2):
            both = len(own & set(w[b:b + window]))
            if both >= least:
                blocks.add((b, label, both / len(own)))
    return len(w), sorted(base), blocks


def telling(text, templates=L.TEMPLATES):
    """label, containment of the windows that hold the telling words and lie in no larger template's."""
    w = WORD.findall((text or "").translate(FOLD))
    held = []
    for t, label in templates.items():
        own = set(t.split())
        window = 16
        while window < 2 * len(t.split()):
            window *= 2
        for b in range(0, max(len(w), 1), window // 2):
            here = set(w[b:b + window])
            if len(own & here) >= -(-800 * len(own) // 1000) and own & set(L.MARKS) <= here:
                held.append((b, min(b + window, len(w)), own, label, len(own & here) / len(own)))
    return {(x[3], x[4]) for x in held if not any(y[2] > x[2] and y[0] < x[1] and x[0] < y[1] for y in held)}


def check(spark, rows):
    df = spark.createDataFrame(rows, hostile.SCHEMA) if len(rows[0]) > 2 else spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in L.scan(df).collect()}
    for i, text in (r[:2] for r in rows):
        n, base, blocks = brute(text)
        r = got[(i, n)]
        assert r["n_base"] == len(base)
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x[1] for x in base}))
        assert {(b["first_word"], b["label"], b["containment"]) for b in r["blocks"]} == blocks
        sure = telling(text)
        assert r["labels"] == ",".join(sorted({x[1] for x in base} | {x[0] for x in sure}))
        assert r["score"] == (1.0 if base else max((x[1] for x in sure), default=0.0))


def test_hostile_rows(spark):
    check(spark, hostile.rows())
    assert L.scan(hostile.empty(spark)).count() == 0


def test_notices_with_gaps_changes_and_noise(spark):
    rng = random.Random(6)
    noise = [*{w for t in L.TEMPLATES for w in t.split()}, *(f"n{i}" for i in range(60))]
    rows = []
    for t in [*L.TEMPLATES, *L.PHRASES]:
        for gone in (0.0, 0.1, 0.2, 0.3):
            w = [x.title() for x in t.split() if rng.random() >= gone]
            if rng.random() < 0.3:
                rng.shuffle(w)
            rows.append((len(rows), " ".join([*rng.choices(noise, k=rng.randrange(60)), *w, *rng.choices(noise, k=rng.randrange(60))])))
    check(spark, rows)


def test_phrase_at_both_ends_and_repeated(spark):
    check(spark, [(1, "Under the MIT License"), (2, "x under the mit-license, under the MIT license."), (3, "CC BY-NC"), (4, "under the mit licenses")])


def test_notices_name_their_own_licence_only(spark):
    want = {"This is released under the Eclipse Public license": "", "Released under the Apache License": "", "Licensed under CC BY 4.0": "cc-by",
            "Licensed under CC BY-NC 4.0": "cc-by-nc", "Released under the MIT License": "mit",
            "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
            "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
            "Licensed under the Apache License, Version 2.0": "apache-2"}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in L.scan(df).collect()}
    assert [got[i] for i in range(len(want))] == [x for x in want.values()]
