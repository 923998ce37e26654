import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import hostile
from threadscope.llm import packing as P
from threadscope.llm import word_ids
from threadscope.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path("byte_bpe_50k.json")


def ids_of(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def one_by_one(lengths, size):
    """Shortest pack first without histogram: every item, longest first, into the pack with fewest tokens."""
    packs = []
    for l in sorted(lengths, reverse=True):
        at = min(range(len(packs)), key=lambda i: packs[i], default=None)
        if at is not None and packs[at] + l <= size:
            packs[at] += l
        else:
            packs.append(l)
    return sorted(packs)


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=150, deadline=None)
def test_histogram_packing_equals_one_by_one(lengths):
    groups = P.pack_lengths(Counter(lengths), 64)
    assert sorted(t for g in groups for t in [g.total] * g.count) == one_by_one(lengths, 64)
    assert all(g.total == sum(l * n for l, n in g.runs) for g in groups)
    placed = Counter()
    for g in groups:
        for l, n in g.runs:
            placed[l] += g.count * n
    assert placed == Counter(lengths)


def check_sequences(pieces, size):
    """pieces: (sequence, offset, length). Gapless from 0; every sequence full or a power of two."""
    by = {}
    for s, o, n in pieces:
        by.setdefault(s, []).append((o, n))
    for found in by.values():
        at = 0
        for o, n in sorted(found):
            assert o == at and n > 0
            at += n
        assert at == size or at & (at - 1) == 0
    return by


@given(st.lists(st.integers(1, 63), max_size=150))
@settings(max_examples=150, deadline=None)
def test_places_fill_all_sequences(lengths):
    size = np.array(lengths, np.int64)
    places = P.fill_gaps(P.pack_lengths(Counter(lengths), 64), 64)
    rank = np.array([lengths[:i].count(l) for i, l in enumerate(lengths)], np.int64)
    row, begin, end, sequence, offset = P.place(size, rank, places)
    by = check_sequences(zip(sequence.tolist(), offset.tolist(), (end - begin).tolist()), 64)
    assert sorted(by) == list(range(places.sequences))
    for i, l in enumerate(lengths):
        spans = sorted(zip(begin[row == i].tolist(), end[row == i].tolist()))
        assert spans[0][0] == 0 and spans[-1][1] == l and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == 1 or l in places.cut_lengths
    assert not (size < 64).all() or sum(64 - sum(n for _, n in f) for f in by.values()) <= 64 * 7


def test_work_does_not_grow_with_the_items():
    groups = P.pack_lengths({l: 10 ** 12 + l for l in range(1, 2048)})
    assert len(groups) < 3 * 2048 and sum(g.total * g.count for g in groups) == sum(l * (10 ** 12 + l) for l in range(1, 2048))


def check(got, rows):
    docs = Counter()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], P.LENGTH)
    for i, text in rows:
        docs[i] += 1
    for i, text in rows:
        ids = ids_of(text)
        mine = [p for p in pieces[i] if p[3] == len(ids)]
        if docs[i] > 1:  # pieces of rows with one id stand together
            assert any(zlib.crc32(np.array(ids[p[0]:p[0] + p[1]], "<u4").tobytes()) == p[2] for p in mine)
            continue
        at = 0
        for start, n, crc, _ in sorted(mine):
            assert start == at and zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()) == crc
            at += n
        assert at == len(ids)
    assert sum(r["length"] for r in got) == sum(len(ids_of(t)) for _, t in rows)


def test_documents_and_hostile_rows(spark):
    rng = random.Random(5)
    extra = [(1000 + i, " ".join(rng.choice(["the", "pack", "of", "wolves", "ran\n"]) for _ in range(rng.randrange(1, 900)))) for i in range(150)]
    extra += [(3000 + i, "the same text") for i in range(200)]
    rows = hostile.rows() + [(i, t, "en", "s", 1, 1, 1, 1, 1, 0.5, 1, 1) for i, t in extra]
    check(P.pack(hostile.docs(spark, rows).repartition(6), PATH).collect(), [r[:2] for r in rows])


def test_empty_table(spark):
    assert P.pack(hostile.empty(spark), PATH).count() == 0


def test_word_table_equals_whole_texts():
    tok = tokenizers.Tokenizer.from_file(PATH)
    encode = word_ids.text_encoder(PATH)
    rng = random.Random(4)
    signs = [*"aAbZ sS'tT 09.,!<>|=\"*-_\n\t\x0b\x0c\x1c\x85\xa0 é ñß×　日本 ½²​😀\r \x00", "   ", "<|endoftext|>", " \n ", "\n\n", "don't"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(16))) for _ in range(6000)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    table = word_ids.WordTable(lambda words: words, full=10)
    for at in range(0, 100, 7):
        assert all(table.ready([[str(i)]])[str(i)] == str(i) for i in range(at, at + 7))
        assert len(table.known) <= 10


def test_words_that_cannot_be_joined():
    """A vocabulary with a token over a blank: the joined text is not taken apart, words are encoded one by one."""
    entries = [b" a", b" b", b" a b"]
    sizes = np.array([len(e) for e in entries])
    got = word_ids.many_words(["a", "b"], lambda texts: [[2] for _ in texts], lambda words: [[0] if w == "a" else [1] for w in words], sizes)
    assert got == [word_ids.little([0]), word_ids.little([1])]
