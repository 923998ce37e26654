import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import hostile
from threadscope.llm import alignment as A
from threadscope.llm.queries import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
PATH_A, PATH_B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=80), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_groups_and_links(a, b, same):
    a, b = [2] * same + a, [2] * same + b
    a[-1] += max(0, sum(b) - sum(a))
    b[-1] += max(0, sum(a) - sum(b))
    ea, eb = np.cumsum(a), np.cumsum(b)
    first_a, first_b, link_a, link_b = A.align(ea, eb)
    cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
    assert first_a.tolist() == [0] + [ea.tolist().index(c) + 1 for c in cuts[:-1]] and first_b.tolist() == [0] + [eb.tolist().index(c) + 1 for c in cuts[:-1]]
    wanted = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - a[i], eb[j] - b[j]) < min(ea[i], eb[j])]
    assert list(zip(link_a.tolist(), link_b.tolist())) == wanted


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [c for c in range(256) if c not in plain]
    return {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(other)}


def brute(rows):
    tok = tokenizers.Tokenizer.from_file(PATH_A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    byte_of = letters()
    docs = []
    for i, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False) if text else None
        b = sp.encode(text) if text else []
        raw_a = [bytes(byte_of[c] for c in t) for t in a.tokens] if text else []
        raw_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, sp.id_to_piece(x)) for x in b)]
        ids_a = a.ids if text else []
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            ids_a, b, raw_a, raw_b = [], [], [], []
        groups, links, x, y, end_a, end_b, x0, y0 = [], [], 0, 0, 0, 0, 0, 0
        while x < len(ids_a):
            links.append((ids_a[x], b[y]))
            la, lb = end_a + len(raw_a[x]), end_b + len(raw_b[y])
            if la <= lb:
                x, end_a = x + 1, la
            if lb <= la:
                y, end_b = y + 1, lb
            if la == lb:
                groups.append((ids_a[x0:x], b[y0:y]))
                x0, y0 = x, y
        docs.append((i, len(ids_a), len(b), groups, links))
    count = Counter(l for d in docs for l in d[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, na, nb, groups, links in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, na, nb, len(groups), len(links), sum(count[l] == best[l[1]] for l in links), sum(count[l] for l in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows():
    rng = random.Random(6)
    signs = [*"aAbZ sS'tT 09.,!<>|=\"*-_\n\t\x0b\x1c\x85\xa0 é ñß×　日本 ½²▁​😀\r \x00", "   ", "<|endoftext|>", "<s>", "</s>", " \n ", "\n\n", "don't", "thing", " unbelievable"]
    return [r[:2] for r in hostile.rows()] + [(100 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(30)))) for i in range(800)]


@pytest.mark.parametrize("sent", [A.SENT, 40, 0])
def test_against_brute_force(spark, sent):
    docs = hostile.docs(spark, [(i, t, "en", "s", 1, 1, 1, 1, 1, 0.5, 1, 1) for i, t in rows()])
    got = A.alignment(docs.repartition(5), PATH_A, PATH_B, sent_pairs=sent)
    assert got.columns == COLUMNS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows())))


def test_groups_as_text(spark):
    docs = hostile.docs(spark, [(1, "Unbelievable naïve café", "en", "s", 1, 1, 1, 1, 1, 0.5, 1, 1)])
    r = A.aligned(docs, PATH_A, PATH_B, spans=True).first()
    assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] and r["groups"].count(";") == r["n_groups"] - 1


def test_empty_table(spark):
    assert A.alignment(hostile.empty(spark), PATH_A, PATH_B).count() == 0
