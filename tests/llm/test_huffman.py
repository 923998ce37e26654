import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import hostile
from threadscope.llm import huffman as H
from threadscope.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def kraft(lengths):
    return sum(2.0 ** -int(n) for n in lengths if n)


@given(st.lists(st.integers(0, 10 ** 9), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_code_is_a_prefix_code_of_bounded_length(counts):
    counts = np.array(counts)
    lengths = H.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= H.LONGEST and kraft(lengths) <= 1
    codes = H.canonical(lengths)
    words = sorted(format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths))
    assert all(not b.startswith(a) for a, b in zip(words, words[1:]))


def test_lengths_are_optimal_and_respect_the_limit():
    import heapq

    rng = random.Random(1)
    counts = np.array([rng.randrange(1, 1000) for _ in range(200)])
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((H.code_lengths(counts) * counts).sum()) == cost
    steep = H.code_lengths(np.array([2 ** i for i in range(40)]), 8)
    assert steep.max() == 8 and kraft(steep) <= 1


@given(st.lists(st.integers(0, 60), max_size=700), st.integers(1, 90))
@settings(max_examples=60, deadline=None)
def test_pack_and_unpack(ids, step):
    ids = np.array(ids, np.int64)
    lengths = H.code_lengths(np.bincount(ids, minlength=61) ** 3)
    bits, offsets = H.pack(ids, H.canonical(lengths), lengths, step)
    assert (H.unpack(bits, offsets, len(ids), H.decoding_table(lengths), step) == ids).all()


def test_encoder_equals_whole_texts():
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    encode = H._encoder(tokenizer_path())
    rng = random.Random(4)
    signs = "aAbZ sS'tT 09.,!<>|=\"*-_\n\t\x0b\x0c\x1c\x85 ̸́éÉñß×÷İıſ“”日本 ½²​😀'reVE"
    for i in range(4000):
        s = "".join(rng.choice(signs) for _ in range(rng.randrange(16)))
        s += rng.choice(["", "", "<|endoftext|>", "<|ENDOFTEXT|> don't", "I'LL it's"]) + s
        assert np.frombuffer(encode(s.encode()), "<u2").tolist() == tok.encode(s, add_special_tokens=False).ids, s


def expected(rows):
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    out = []
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_files_of_hostile_rows(spark, tmp_dir):
    got = H.token_files(hostile.docs(spark), f"{tmp_dir}/ids", tokenizer_path(), part_ids=100_000).collect()
    want = expected([r[:2] for r in hostile.rows()])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0, *(r["n_tokens"] for r in order)])[:-1].tolist()
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)


def test_empty_table(spark, tmp_dir):
    assert H.token_files(hostile.empty(spark), f"{tmp_dir}/none", tokenizer_path()).count() == 0


def test_a_damaged_file_is_refused():
    lengths = H.code_lengths(np.array([3, 2, 1]))
    block = H._record(b"B", H._block([(1, np.array([0, 1, 2], "<u2").tobytes())], H.canonical(lengths), lengths)) + H.MARK.encode()
    with pytest.raises(ValueError):
        list(H._records(block[:-3]))
