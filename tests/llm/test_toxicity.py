import math
import random
import zlib

import numpy as np

from tests.llm import hostile
from threadscope.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int, text string, y int"


def corpus(n=900, seed=4):
    """Toxic texts hold an insult; half of those also name a group, and few clean ones do."""
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "Moron!", "scum,"])
        if rng.random() < (0.6 if toxic else 0.05):
            w[rng.randrange(len(w))] = rng.choice(["muslims", "women"])
        rows.append((i, " ".join(w) + "."))
        if i % 4:
            labels.append((i, 1, int(toxic), "t", 9))
        rows[-1] = (*rows[-1], int(toxic))
    return rows, labels


def scored(spark, rows, labels, **options):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = T.score(docs, spark.createDataFrame(labels, LABELS), **options).collect()
    return {r["doc_id"]: r for r in got}


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows, labels = corpus()
    extra = [(10_000 + i, f"word{i} word{i + 1} many {g} live here word{i + 2}.", 0) for i, g in enumerate(T.IDENTITY_TERMS)]
    got = scored(spark, rows + extra, labels)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert len(held) > 200 and np.mean([got[i]["predicted"] == y for i, _, y in held]) > 0.97
    assert not any(got[i]["predicted"] for i, _, _ in extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_penalty_takes_the_weight_off_group_names():
    """One feature is an insult, one a group name that goes with it in the labels."""
    rng = random.Random(1)
    texts, pairs = [], []
    for _ in range(400):
        y = int(rng.random() < 0.5)
        texts.append((y, np.array([i for i, on in enumerate((y and rng.random() < 0.8, rng.random() < (0.7 if y else 0.1))) if on], int)))
        pairs.append((np.array([1]), np.array([], int)))
    free, _ = T.fit(texts, [], 2)
    held, _ = T.fit(texts, pairs, 2, penalty=50.0)
    assert free[1] > 1 and abs(held[1]) < 0.1 * free[1] and held[0] > 1


def test_sentences_are_swapped():
    got = T._counterfactuals(b"Some Women came. Nothing here\nwomen and men", ("women", "men"))
    assert got == [(b"Some Women came", b"Some men came"), (b"Some Women came", b"Some people came"),
                   (b"women and men", b"men and women"), (b"women and men", b"people and people")]


def test_hostile_rows(spark):
    labels = [(1, 1, 1, "x", 0), (2, None, None, None, None), (None, 1, 1, "x", 0), (4, 0, 0, "x", 0), (4, 0, 1, "x", 0), (12, 1, 0, "x", 0), (999, 1, 1, "x", 0), (9, 0, 0, "x", 0)]
    docs = hostile.docs(spark)
    got = T.score(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(hostile.rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert T.score(hostile.empty(spark), spark.createDataFrame(labels, LABELS)).count() == 0
    none = T.score(docs, spark.createDataFrame([], LABELS)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 0)}
    assert T.without_toxic(docs, spark.createDataFrame([], LABELS)).count() == len(hostile.rows())


def test_score_depends_on_the_text_alone(spark):
    rows, labels = corpus(300)
    rows += [(100_000 + i, t, y) for i, t, y in rows]
    got = scored(spark, rows, labels)
    assert all(got[i]["score"] == got[100_000 + i]["score"] for i in range(300))


def plain_cells(text):
    """Words and five-byte runs by Python's own loops; the hashes are the operator's constants."""
    low = "".join(c if c.isalnum() else " " for c in text.lower())
    found = {T.word_hashes(np.frombuffer(w.encode(), np.uint8), T.ALNUM)[0].item() >> (64 - T.BITS) for w in low.split()}
    padded = f" {low} ".encode()
    for i in range(len(padded) - 4):
        run = int.from_bytes(padded[i:i + 5], "big")
        found.add((run * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - T.BITS)) + (1 << T.BITS))
    return found


def test_features_and_scores_against_plain_loops(spark):
    rows, labels = corpus(300, seed=8)
    y_of = {i: toxic for i, _, toxic, *_ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    cells = {i: plain_cells(t) for i, t, _ in rows}
    n = [sum(1 for y in y_of.values() if y == k) for k in (0, 1)]
    counts = {}
    for i, y in y_of.items():
        for c in cells[i]:
            counts.setdefault(c, [0, 0])[y] += 1
    gain = {}
    for c, seen in counts.items():
        g = 0.0
        for k in (0, 1):
            for part, whole in ((seen[k], sum(seen)), (n[k] - seen[k], sum(n) - sum(seen))):
                if part and whole:
                    g += 2 * part * math.log(part / (whole * n[k] / sum(n)))
        gain[c] = g
    chosen = sorted(c for c in sorted(gain, key=lambda c: (-gain[c], c))[:T.FEATURES] if gain[c] > 10.8)
    assert 0 < len(chosen) < T.FEATURES
    place = {c: i for i, c in enumerate(chosen)}
    vector = lambda found: np.array(sorted(place[c] for c in found if c in place), int)
    text_of, pairs = {i: t for i, t, _ in rows}, []
    for i in y_of:
        for a, b in T._counterfactuals(text_of[i].encode(), T.IDENTITY_TERMS):
            pairs.append((vector(plain_cells(a.decode())), vector(plain_cells(b.decode()))))
    weights, intercept = T.fit([(y, vector(cells[i])) for i, y in y_of.items()], pairs, len(chosen))
    got = scored(spark, rows, labels)
    for i, _, _ in rows:
        z = weights[vector(cells[i])].sum() + intercept
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 2e-3


def test_the_sample_takes_copies_in_their_share(spark, monkeypatch):
    """400 equal rows and 400 different ones of one label: a sample of 100 holds some of both."""
    monkeypatch.setattr(T, "FIT_ROWS", 100)
    rows = [(i, "word00 same same same" if i < 400 else f"word{i % 20:02d} w{i}", 0) for i in range(800)]
    train = spark.createDataFrame(rows, "doc_id long, text string, y int")
    train = train.selectExpr("doc_id", "cast(text AS binary) text", "y")
    chosen = np.unique(np.concatenate([T.cells_of(np.frombuffer(f"word{i:02d}".encode(), np.uint8)) for i in range(20)]))
    texts, _ = T._fit_rows(train, chosen, T.IDENTITY_TERMS)
    again, _ = T._fit_rows(train.repartition(7), chosen, T.IDENTITY_TERMS)
    same = T._Lookup(chosen)(np.frombuffer(b"word00 same same same", np.uint8)).tolist()
    equal = sum(x.tolist() == same for _, x in texts)
    assert len(texts) == 100 and 30 <= equal <= 70
    assert [x.tolist() for _, x in texts] == [x.tolist() for _, x in again]
