"""Token ids of whole texts from a table of their words.

Neither vocabulary used here has a token that goes from a non-blank over a blank, so the ids of a text
are those of its words, each with the blank before it, in order. Words are taken through the library
once, in batches, and looked up afterwards; the table is emptied when it is full, so a worker's memory
does not grow with the corpus. A text of any length needs memory for itself only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

FULL = 1_000_000  # words a table holds, about 200 bytes each
_JOINED = 200  # words encoded as one text
#: A blank that white space or the end follows. Only with one of these may a run of white space hold more than one blank.
_RUN = re.compile(r" (?=\s|\Z)")
#: Where any text may be cut: before a blank that white space does not precede.
_CUT = re.compile(r"(?<=\S)(?= )")


def words_of(text: str) -> tuple[str, list[str]]:
    """What stands before the first cut, and every later part without its leading blank."""
    if _RUN.search(text):
        parts = _CUT.split(text)
        head = "" if parts[0].startswith(" ") else parts.pop(0)
        return head, [p[1:] for p in parts]
    head, *rest = text.split(" ")
    return head, rest


class WordTable:
    """word -> whatever ``fill`` gives for it; ``fill`` takes a list of words."""

    def __init__(self, fill: Callable[[list[str]], Iterable], full: int = FULL):
        self.fill, self.full, self.known = fill, full, {}

    def ready(self, words: Iterable[list[str]]) -> dict:
        """The table, with every given word in it."""
        missing = set().union(*words).difference(self.known)  # looks its own members up in the dict
        if missing:
            if len(self.known) + len(missing) > self.full:
                self.known.clear()
                missing = set().union(*words)
            todo = list(missing)
            for at in range(0, len(todo), 1 << 15):
                part = todo[at:at + (1 << 15)]
                self.known.update(zip(part, self.fill(part)))
        return self.known


def little(ids: list[int]) -> bytes:
    return np.array(ids, "<u2").tobytes()


def entry_bytes(entries: list[str]) -> list[bytes]:
    """The bytes of the entries of a byte-level vocabulary (an entry with other letters stands for itself).

    The letters are printable Latin-1 characters for the bytes of their code, and 256 on for the others."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(plain)))}
    return [bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries]


def many_words(words: list[str], whole: Callable[[list[str]], list[list[int]]], each: Callable[[list[str]], list[list[int]]],
               sizes: np.ndarray, odd: str = "") -> list[bytes]:
    """Ids (u16 LE) of a blank and each word. Words that begin and end with other than white space, and do not hold
    ``odd``, are encoded many as one text, which is taken apart at their ends; the others one by one, and so are all
    if a word should not end where a token does."""
    joined = [w for w in words if w and w.strip() == w and not (odd and odd in w)]
    known = {}
    if joined:
        found = whole([" " + " ".join(joined[at:at + _JOINED]) for at in range(0, len(joined), _JOINED)])
        ids = np.concatenate([np.array(x, "<u2") for x in found])
        ends = np.cumsum(sizes[ids], dtype=np.int64)
        stops = np.cumsum([len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in joined])
        at = np.searchsorted(ends, stops)
        if len(ends) and ends[-1] == stops[-1] and (ends[at] == stops).all():
            cuts, data = [0, *(2 * (at + 1)).tolist()], ids.tobytes()
            known = dict(zip(joined, [data[x:y] for x, y in zip(cuts, cuts[1:])]))
    rest = [w for w in words if w not in known] if len(known) < len(words) else []
    if rest:
        known.update(zip(rest, map(little, each(rest))))
    return [known[w] for w in words]


@lru_cache(maxsize=4)
def byte_bpe(path: str, plain_specials: bool = False):
    """Of a byte-level BPE file: texts -> id lists, words -> ids of a blank and the word (u16 LE), the bytes of every id
    and their numbers. The strings of special tokens are plain text if asked."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain_specials
    if tok.get_vocab_size() > 1 << 16:
        raise ValueError("ids beyond 16 bits")
    entries = entry_bytes([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())])
    sizes = np.array([len(e) for e in entries], np.uint32)

    def texts(some: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast(some, add_special_tokens=False)]

    def words(some: list[str]) -> list[bytes]:
        return many_words(some, texts, lambda rest: texts([" " + w for w in rest]), sizes)

    return texts, words, entries, sizes


@lru_cache(maxsize=4)
def text_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Whole texts -> ids (u16 LE bytes) as the library gives for each text."""
    texts, words, _, _ = byte_bpe(path)
    inner = WordTable(words)
    first = WordTable(lambda heads: map(little, texts(heads)))

    def run(texts: list[str]) -> list[bytes]:
        parts = [words_of(t) for t in texts]
        heads = first.ready([[h for h, _ in parts]])
        known = inner.ready([r for _, r in parts])
        return [heads[h] + b"".join([known[w] for w in r]) for h, r in parts]

    return run


def text_groups(column, rows: int = 512, size: int = 1 << 22) -> Iterable[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``size`` bytes of a binary column."""
    from .common import byte_rows

    begin = total = 0
    for i, x in enumerate(byte_rows(column)):
        if i > begin and (i - begin >= rows or total + len(x) > size):
            yield begin, i
            begin, total = i, 0
        total += len(x)
    if len(column) > begin:
        yield begin, len(column)
