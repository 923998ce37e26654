import math
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tests.llm import hostile
from threadscope.llm import hmm
from threadscope.llm.common import SPACED, word_hashes

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def model(k=3, v=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = lambda *s: (x := rng.random(s) + 0.05) / x.sum(-1, keepdims=True)
    return hmm.Model(rows(k), rows(k, k), rows(k, v))


def test_likelihood_and_expected_counts_equal_the_sum_over_all_paths():
    m = model()
    texts = [np.array(t) for t in ([0], [1, 2], [4, 0, 3, 3], [2, 1, 0, 4, 2, 2])]
    starts, moves, emits, ll = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), []
    for t in texts:
        total, s, mv, e = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
        for path in product(range(3), repeat=len(t)):
            p = m.start[path[0]] * m.emit[path[0], t[0]]
            for a, b, x in zip(path, path[1:], t[1:]):
                p *= m.move[a, b] * m.emit[b, x]
            total += p
            s[path[0]] += p
            for a, b in zip(path, path[1:]):
                mv[a, b] += p
            for z, x in zip(path, t):
                e[z, x] += p
        ll.append(math.log(total))
        starts, moves, emits = starts + s / total, moves + mv / total, emits + e / total
    c = hmm._Chunks(texts)
    a, b, d, total = c.expected(m)
    assert c.log_likelihood(m) == pytest.approx(ll) and total == pytest.approx(sum(ll))
    assert a == pytest.approx(starts) and b == pytest.approx(moves) and d == pytest.approx(emits)


def test_chunk_borders_and_long_texts(monkeypatch):
    m = model(4, 9, 2)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 9, n) for n in (1, 63, 64, 65, 127, 128, 129, 5000)]

    want = []
    for t in texts:
        now = m.start * m.emit[:, t[0]]
        total = math.log(now.sum())
        now = now / now.sum()
        for x in t[1:]:
            now = (now @ m.move) * m.emit[:, x]
            total += math.log(now.sum())
            now = now / now.sum()
        want.append(total)
    assert hmm._Chunks(texts).log_likelihood(m) == pytest.approx(want)
    whole = hmm._Chunks(texts).expected(m)
    monkeypatch.setattr(hmm, "_SLAB", 5)
    for x, y in zip(whole, hmm._Chunks(texts).expected(m)):
        assert x == pytest.approx(y)
    assert whole[2].sum() == pytest.approx(sum(map(len, texts)))


def test_expected_counts_over_chunk_borders_equal_a_plain_forward_and_backward_pass(monkeypatch):
    m = model(4, 9, 2)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n) for n in (700, 1, 63, 64, 65, 2, 128, 129, 64)]
    starts, moves, emits = np.zeros(4), np.zeros((4, 4)), np.zeros((4, 9))
    for t in texts:
        n = len(t)
        alpha, beta = np.empty((n, 4)), np.ones((n, 4))
        for i, x in enumerate(t):
            alpha[i] = (alpha[i - 1] @ m.move if i else m.start) * m.emit[:, x]
            alpha[i] /= alpha[i].sum()
        for i in reversed(range(n - 1)):
            beta[i] = m.move @ (m.emit[:, t[i + 1]] * beta[i + 1])
            beta[i] /= beta[i].sum()
        for i, x in enumerate(t):
            post = alpha[i] * beta[i]
            emits[:, x] += post / post.sum()
            if i:
                pair = alpha[i - 1][:, None] * m.move * (m.emit[:, x] * beta[i])
                moves += pair / pair.sum()
            else:
                starts += post / post.sum()
    for slab in (4096, 7, 1):
        monkeypatch.setattr(hmm, "_SLAB", slab)
        a, b, c, _ = hmm._Chunks(texts).expected(m)
        assert a == pytest.approx(starts) and b == pytest.approx(moves) and c == pytest.approx(emits)


def test_a_training_round_costs_little_beside_hashing_the_words():
    """Four rounds read every token: with states as the last axis of the arrays one took several times the hashing."""
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 8258, 400) for _ in range(500)]
    texts = [np.frombuffer(" ".join(f"{x:05d}" for x in w).encode(), np.uint8) for w in words]
    chunks, m = hmm._Chunks(words), hmm.Model.initial(np.full(8258, 1 / 8258))

    def cost(f):
        took = []
        for _ in range(5):
            begun = time.process_time()
            f()
            took.append(time.process_time() - begun)
        return min(took)

    assert cost(lambda: chunks.expected(m)) < 1.5 * cost(lambda: [word_hashes(t, SPACED) for t in texts])


def test_training_raises_the_likelihood(spark):
    rng = np.random.default_rng(5)
    texts = [(rng.integers(0, 8, 200) + 8 * (i % 2)).astype("<u2").tobytes() for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "syms binary").repartition(4)
    _, seen = hmm.train(df, np.full(16, 1 / 16), 2, 6)
    assert all(b > a for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]


def base(rows):
    toks = [(i, [*(t or "").encode().translate(LOWER).split(), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(x for i, w in toks if not held(i) for x in w)
    n, z = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    return [(i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(c[x] + 0.5) - z for x in w)) for i, w in toks]


@pytest.mark.parametrize("known, symbols", [(1 << 18, 8192), (40, 10)])
def test_base_scores_with_and_without_a_table_of_rare_words(spark, known, symbols):
    rows = [r[:2] for r in hostile.rows() if len(r[1] or "") < 500_000] + [(i, f"same words here {i % 7} only{i}") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = hmm.score(df, known=known, symbols=symbols, rounds=1).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    want, found = sorted(base(rows), key=key), sorted((tuple(r)[:6] for r in got), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in want])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_the_end_is_known_whatever_its_count(spark):
    """Two long documents: every word is more frequent than the end, which the step of the count would drop."""
    rows = [(i, " ".join(f"w{k % 300}" for k in range(6000))) for i in (2, 4)]
    assert not any(held for _, held, *_ in base(rows))
    got = sorted(tuple(r)[:6] for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), known=10, rounds=1).collect())
    assert [r[:5] for r in got] == [r[:5] for r in base(rows)] and [r[5] for r in got] == pytest.approx([r[5] for r in base(rows)])


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"l{i % 2}w{int(x)}" for x in rng.zipf(1.5, 80) % 500)) for i in range(600)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 50 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_hostile_rows_and_empty_table(spark):
    got = hmm.score(hostile.docs(spark), rounds=1).collect()
    assert len(got) == len(hostile.rows()) and all(math.isfinite(r["score"]) for r in got)
    assert hmm.score(hostile.empty(spark), rounds=1).count() == 0
    same = hmm.score(hostile.docs(spark).where("doc_id = 14 or doc_id = 1"), rounds=1).collect()
    assert len({r["score"] for r in same if r["doc_id"] == 14}) == 1
